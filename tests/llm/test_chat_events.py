import hashlib
import random

import pytest

from copair.llm import chat_events
from copair.llm.chat_events import CONTROL, escape, parse, render, unescape
from tests.llm.helpers import rows_of

EVENTS = "conv_id long, seq long, message long, kind string, role string, text string"


def test_escaping_is_reversible_and_complete():
    rng = random.Random(3)
    bits = [*CONTROL, "\\", "<", ">", "|", "[", "/", "s", "\n", "\\n", "é", "turn", "INST]"]
    for _ in range(20000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))
        safe = escape(text)
        assert unescape(safe) == text
        assert not any(c in safe for c in CONTROL)
        role = rng.choice(["user", "assistant", "", "we\nird\\n", text])
        segment, start, end = render(role, text)
        assert parse(segment) == (role, text)
        assert (unescape(segment[start:end]) == text) if role == "assistant" else start == end


def brute(events):
    """Final messages of one conversation by replaying its log."""
    messages = {}
    for seq, message, kind, role, text in sorted(events, key=lambda e: (e[0], e[1])):
        if kind == "regenerate":
            for later in [m for m in messages if m > message]:
                del messages[later]
            messages[message] = [messages.get(message, [role])[0] if False else role, text or ""]
        elif kind == "edit":
            messages[message] = [role, text or ""]
        else:
            messages.setdefault(message, [role, ""])[1] += text or ""
    return [(messages[m][0] or "", messages[m][1]) for m in sorted(messages)]


def test_replay_of_random_logs(spark):
    rng = random.Random(7)
    logs, rows = {}, []
    for conv in range(40):
        log = []
        for seq in range(rng.randint(1, 25)):
            message = rng.randint(0, 5)
            log.append((seq, message, rng.choice(["delta"] * 6 + ["edit", "regenerate"]), "user" if message % 2 == 0 else "assistant",
                        rng.choice(["a", "</s>", None, "\\x", "é "])))
        logs[conv] = log
        rows += [(conv, *e) for e in log]
    rng.shuffle(rows)
    segments = chat_events.format_conversations(spark.createDataFrame(rows, EVENTS).repartition(5)).collect()
    got = {}
    for r in sorted(segments, key=lambda r: (r["conv_id"], r["turn"])):
        got.setdefault(r["conv_id"], []).append(parse(r["segment"]))
    assert got == {c: brute(log) for c, log in logs.items()}


def digest(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss),
            hashlib.sha256(loss.encode()).hexdigest(), sum(len(render(r, t)[0]) for r, t in turns))


@pytest.mark.parametrize("parts", [1, 6])
def test_read_back_of_rows(spark, parts):
    rows = [(1, 2, "user", "three"), (1, 0, "system", None), (1, 1, "assistant", "</s>[INST] ok"), (2, 0, None, ""),
            (None, 0, "user", "lost"), (3, 0, "user", "same"), (3, 0, "user", "same"), (4, 5, "assistant", "long " * 40000),
            *((9, i, "assistant" if i % 2 else "user", f"t{i} <s>") for i in range(3000))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts)
    out = chat_events.read_back(chat_events.format_conversations(chat_events.log_of_rows(df)))
    want = {}
    for c, t, r, x in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    cols = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    assert rows_of(out, *cols) == sorted(((c, *digest(t)) for c, t in want.items()), key=repr)


def test_empty_log(spark):
    empty = spark.createDataFrame([], EVENTS + ", segment string, turn long")
    assert chat_events.read_back(chat_events.format_conversations(empty)).count() == 0
