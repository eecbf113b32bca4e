"""Personal data: exact base patterns, and a linear-chain CRF that adds what they miss.

``base_spans`` finds the four kinds by their patterns, in linear time on any text.
The conditional random field labels tokens (runs of letters, runs of digits, single
marks) from their word shapes and neighbours.  Every kind needs a digit, an at-sign
or a spelled one (``(at)``, ``[dot]``, ``at host dot com``), so its chains are the
neighbourhoods of those, found over the whole text and as long as an address goes
on; elsewhere all labels are O.  It is trained with numpy on a small
labelled table: windows of a bounded sample of the documents labelled by the base
patterns, and template rows for the spellings that the patterns miss, set between
words of the sample.  Viterbi decodes padded batches of chains in numpy.

A decoded address is completed to its ends.  A span is added if it passes the kind's
check (``_valid``) and overlaps no base span; base spans always stay.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copair.llm.common import hash_sample

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
#: 14 digits or more; shorter chains fail the count anyway.
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){13,}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _octets(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def _ascii_digits(s: str) -> str:
    return "".join(_DIGITS.findall(s))


def base_spans(text: str) -> list[Span]:
    """Base spans by start, then kind; code points, end exclusive."""
    out: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            last = m.end()
        else:
            last = at + 1  # an at-sign ends every local part before it
        at = text.find("@", last)
    if _DIGITS.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _octets(m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = _ascii_digits(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(_ascii_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# ---------------------------------------------------------------------------
# tokens, shapes and chains
# ---------------------------------------------------------------------------

_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\s]")
_TRIGGER = re.compile(r"[0-9@]+|[(\[]\s?(?:at|dot)\s?[)\]]|(?<!\w)(?:at\s[\w-]+(?=\sdot\s)|dot)(?!\w)", re.I)
#: Characters of context on both sides of a trigger; an address that goes on there is followed to its end.
CONTEXT = 24
_BACK = re.compile(r"[\w.%+-]")
_ONWARD = re.compile(r"(?:[\w.%+-]++|\s(?=\.\s?[\w-])|(?<=\.)\s(?=[\w-]))*+")
_MARKS = "@.-()+[]:/,_#=&%*\"'!?"
_CUES = ("at", "dot", "tel", "phone", "call", "card", "visa", "ip", "host", "mail", "email", "version", "com", "org", "net")
#: Shapes: 0 outside, then digits by length and value, letters by length and case, cues, marks, others.
_N_DIGIT, _N_LETTER = 10, 6
_CUE_AT = 1 + _N_DIGIT + _N_LETTER
_MARK_AT = _CUE_AT + len(_CUES)
SHAPES = _MARK_AT + len(_MARKS) + 1
_CUE_OF = {w: _CUE_AT + i for i, w in enumerate(_CUES)}
_MARK_OF = {c: _MARK_AT + i for i, c in enumerate(_MARKS)}


def shape(token: str) -> int:
    first = token[0]
    if "0" <= first <= "9":
        n = len(token)
        if n <= 3:
            return 1 + (n - 1 if int(token) <= 255 else 3)
        return 1 + (4 if n == 4 else 5 if n <= 6 else 6 if n <= 9 else 7 if n <= 13 else 8 if n <= 19 else 9)
    if first.isalpha():
        low = token.lower()
        if low in _CUE_OF:
            return _CUE_OF[low]
        case = 0 if token == low else 1 if token[1:] == low[1:] else 2
        return 1 + _N_DIGIT + case * 2 + (len(token) > 3)
    return _MARK_OF.get(first, SHAPES - 1)


def chains(text: str) -> list[tuple[int, int]]:
    """Maximal neighbourhoods of triggers, as character ranges cut at token borders and never inside an address."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        start, end = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        last = out[-1][1] if out else 0
        if end > last:
            end = _ONWARD.match(text, end).end()
        while start > last and _BACK.match(text, start - 1):
            start -= 1
        if out and start <= last:
            out[-1][1] = max(end, last)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


@dataclass
class Chain:
    starts: list[int]
    ends: list[int]
    shapes: list[int]
    spaced: list[int]


def chain_tokens(text: str, start: int, end: int) -> Chain:
    found = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text, start, end)]
    spaced = [int(i == 0 or s > found[i - 1][1]) for i, (s, _, _) in enumerate(found)]
    return Chain([f[0] for f in found], [f[1] for f in found], [shape(f[2]) for f in found], spaced)


# ---------------------------------------------------------------------------
# the conditional random field
# ---------------------------------------------------------------------------

LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
N_LABELS = len(LABELS)
_CELLS = 2 * SHAPES  # shape with or without a space before
_UNI, _BI = (-2, -1, 0, 1, 2), ((-2, -1), (-1, 0), (0, 1), (1, 2), (-1, 1))
N_FEATURES = len(_UNI) * _CELLS + len(_BI) * _CELLS * _CELLS + 1
_NEVER = -1e4


def allowed() -> np.ndarray:
    """``[from, to]``: an inside label follows only its own kind."""
    ok = np.ones((N_LABELS, N_LABELS), dtype=bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return ok


def batch_features(group: list[Chain]) -> tuple[np.ndarray, np.ndarray]:
    """``(rows, steps, features)`` feature numbers, and the mask of real steps."""
    longest = max(len(c.shapes) for c in group)
    pad = 2
    cell = np.zeros((len(group), longest + 2 * pad), dtype=np.int64)
    mask = np.zeros((len(group), longest), dtype=bool)
    for i, c in enumerate(group):
        n = len(c.shapes)
        cell[i, pad:pad + n] = 2 * np.array(c.shapes) + np.array(c.spaced)
        mask[i, :n] = True
    at = lambda d: cell[:, pad + d:pad + d + longest]
    feats = [at(d) + j * _CELLS for j, d in enumerate(_UNI)]
    base = len(_UNI) * _CELLS
    feats += [base + j * _CELLS * _CELLS + at(a) * _CELLS + at(b) for j, (a, b) in enumerate(_BI)]
    feats.append(np.full((len(group), longest), N_FEATURES - 1))
    return np.stack(feats, axis=2), mask


@dataclass
class CRF:
    emit: np.ndarray  # (features, labels)
    move: np.ndarray  # (labels, labels)
    first: np.ndarray  # (labels,)

    def scores(self, feats: np.ndarray) -> np.ndarray:
        return self.emit[feats].sum(axis=2)

    def viterbi(self, group: list[Chain]) -> list[np.ndarray]:
        """Best labels of each chain, decoded as one padded batch."""
        feats, mask = batch_features(group)
        emit = self.scores(feats)
        rows, steps, _ = emit.shape
        back = np.zeros((rows, steps, N_LABELS), dtype=np.int8)
        score = self.first + emit[:, 0]
        for t in range(1, steps):
            through = score[:, :, None] + self.move
            back[:, t] = through.argmax(axis=1)
            score = np.where(mask[:, t, None], through.max(axis=1) + emit[:, t], score)
        out, length = np.zeros((rows, steps), dtype=np.int8), mask.sum(axis=1)
        label, row = score.argmax(axis=1), np.arange(rows)
        for t in range(steps - 1, -1, -1):
            here = t < length
            out[:, t] = np.where(here, label, 0)
            if t:
                label = np.where(here, back[row, t, label], label)
        return [out[i, :n] for i, n in enumerate(length)]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def train(rows: list[tuple[Chain, list[int]]], steps: int = 50, rate: float = 0.25, ridge: float = 1e-3) -> CRF:
    """Maximum likelihood by Adam on the full small table, gradients by forward-backward."""
    ok = allowed()
    ban = np.where(ok, 0.0, _NEVER)
    start_ban = np.array([_NEVER if name.startswith("I-") else 0.0 for name in LABELS])
    feats, mask = batch_features([c for c, _ in rows])
    n, longest = mask.shape
    gold = np.zeros((n, longest), dtype=np.int64)
    for i, (_, y) in enumerate(rows):
        gold[i, :len(y)] = y
    used, flat = np.unique(feats[mask], return_inverse=True)
    flat = flat.reshape(-1, feats.shape[2])
    of_step = np.zeros((n, longest), dtype=np.int64)
    of_step[mask] = np.arange(mask.sum())
    order = np.argsort(flat.ravel(), kind="stable")
    owner = order // flat.shape[1]
    cuts = np.searchsorted(flat.ravel()[order], np.arange(len(used)))
    emit, move, first = np.zeros((len(used), N_LABELS)), np.zeros((N_LABELS, N_LABELS)), np.zeros(N_LABELS)
    params, moments = [emit, move, first], [[np.zeros_like(p), np.zeros_like(p)] for p in (emit, move, first)]
    hot = np.zeros((n, longest, N_LABELS))
    hot[np.arange(n)[:, None], np.arange(longest), gold] = mask
    pair_gold = np.zeros((N_LABELS, N_LABELS))
    both = mask[:, 1:]
    np.add.at(pair_gold, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    for step in range(1, steps + 1):
        e = np.zeros((n, longest, N_LABELS))
        e[mask] = emit[flat].sum(axis=1)
        m, f = move + ban, first + start_ban
        alpha = np.empty((n, longest, N_LABELS))
        alpha[:, 0] = f + e[:, 0]
        for t in range(1, longest):
            nxt = _logsum(alpha[:, t - 1, :, None] + m, 1) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], nxt, alpha[:, t - 1])
        total = _logsum(alpha[:, -1], 1)
        beta = np.zeros((n, longest, N_LABELS))
        pair = np.zeros((N_LABELS, N_LABELS))
        for t in range(longest - 2, -1, -1):
            inner = m + (e[:, t + 1] + beta[:, t + 1])[:, None, :]
            live = mask[:, t + 1]
            beta[:, t] = np.where(live[:, None], _logsum(inner, 2), 0)
            joint = np.exp(np.minimum(alpha[live, t, :, None] + inner[live] - total[live, None, None], 0))
            pair += joint.sum(axis=0)
        post = np.where(mask[:, :, None], np.exp(np.minimum(alpha + beta - total[:, None, None], 0)), 0)
        diff = (post - hot)[mask]
        grads = [np.add.reduceat(diff[owner], cuts, axis=0) / n + ridge * emit,
                 (pair - pair_gold) / n * ok + ridge * move, (post[:, 0] - hot[:, 0]).sum(axis=0) / n + ridge * first]
        for p, g, mo in zip(params, grads, moments):
            mo[0] += 0.1 * (g - mo[0])
            mo[1] += 0.01 * (g * g - mo[1])
            p -= rate * (mo[0] / (1 - 0.9 ** step)) / (np.sqrt(mo[1] / (1 - 0.99 ** step)) + 1e-8)
    whole = np.zeros((N_FEATURES, N_LABELS), dtype=np.float32)
    whole[used] = emit
    return CRF(whole, (move + ban).astype(np.float32), (first + start_ban).astype(np.float32))


# ---------------------------------------------------------------------------
# the labelled table
# ---------------------------------------------------------------------------

#: Spellings beside the base patterns (D: a digit, A: a letter, O: a number to 255, C: a valid card number's digits).
TEMPLATES = {
    "phone": ("(DDD) DDD-DDDD", "DDD-DDD-DDDD", "DDD.DDD.DDDD", "(DDD) DDD DDDD", "00DD DDDD DDDDDD", "D-DDD-DDD-DDDD"),
    "email": ("AAAA (at) AAAA.com", "AAAA [at] AAAAA.org", "AAAA @ AAAA.com", "AAA.AAAA [at] AAAAA [dot] com", "AAADD (at) AAAA.net",
              "AAAAA @ AAAA.AAAAAA-AAAAA.AAAAA.com", "AAAA (at) AAAAA-AAAA.AAAA.org", "AAAA [at] AAAA [dot] AAAAA [dot] net",
              "AAA.AAAA at AAAAA dot com", "AAAAA at AAAA dot AAAAA dot org"),
    "ip": ("O[.]O[.]O[.]O", "O . O . O . O", "O[.]O.O.O"),
    "card": ("CCCC.CCCC.CCCC.CCCC", "CCCC/CCCC/CCCC/CCCC", "CCCC  CCCC  CCCC  CCCC"),
}
#: Numbers that are no personal data.
PLAIN = ("DD.D", "D.D.D", "version D.D", "DDDD", "DD", "DDDD-DD-DD", "DD:DD", "DD:DD:DD", "D,DDD", "DD%", "DDD DDD", "DDDD DDDD",
         "DDD-DDDD", "AAADAADDADA", "A=DDDADADD", "DDDDD", "DDDDDDDD", "#DDD", "AAA@", "@AAAA", "(DD)", "[D]", "D.D.D.D.D.D",
         "AAAA at AAAAA dot AAAAAA", "AAAA dot AAAA", "at AAAAA.com", "AAAA (at AAAA) AAAA", "[dot]", "AAAA (dot) AAAA")


def _fill(pattern: str, rng: np.random.Generator) -> str:
    body = "4" + "".join(map(str, rng.integers(0, 10, 14)))
    card = iter(next(body + str(d) for d in range(10) if luhn(body + str(d))))
    draw = {"D": lambda: str(rng.integers(0, 10)), "A": lambda: chr(97 + int(rng.integers(0, 26))),
            "O": lambda: str(rng.integers(1, 256)), "C": lambda: next(card)}
    return "".join(draw[c]() if c in draw else c for c in pattern)


def labels_of(chain: Chain, spans: list[Span]) -> list[int]:
    out = [0] * len(chain.starts)
    for kind, a, b in spans:
        k, begun = KINDS.index(kind), False
        for i, (s, e) in enumerate(zip(chain.starts, chain.ends)):
            if s >= a and e <= b and not out[i]:
                out[i] = 2 + 2 * k if begun else 1 + 2 * k
                begun = True
    return out


def labelled_windows(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample: int = 2000,
                     rows: int = 500) -> list[tuple[str, list[Span]]]:
    """The small labelled table: ``(text, spans)``, at most ``rows`` real windows and the templates.

    Windows come from a hash sample of about ``sample`` documents.
    """
    picked = hash_sample(docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")), sample, "id")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                found = chains(text)[:4]  # training rows only: a few of each document
                out += [text[a:b] for a, b in found if b - a < 110]
                out.append(" ".join(text[:200].split()[:8]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["window"])

    seen = picked.select("text").mapInArrow(windows, "window string").distinct()
    texts = [r[0] for r in seen.orderBy(F.xxhash64("window"), "window").limit(rows).collect()]
    rng = np.random.default_rng(2)
    words = [w for t in texts for w in t.split() if w.isalpha()] or ["the", "and", "of"]
    table = [(t, base_spans(t)) for t in texts]
    around = lambda: " ".join(words[int(i)] for i in rng.integers(0, len(words), int(rng.integers(0, 4))))
    for kind, patterns in TEMPLATES.items():
        for pattern in patterns:
            for _ in range(20):
                before, value = around(), _fill(pattern, rng)
                table.append((f"{before} {value} {around()}", [(kind, len(before) + 1, len(before) + 1 + len(value))]))
    for pattern in PLAIN:
        for _ in range(12):
            line = f"{around()} {_fill(pattern, rng)} {around()}"
            table.append((line, base_spans(line)))
    return table


def learn(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> CRF:
    rows = []
    for text, spans in labelled_windows(docs, text_col, id_col, **options):
        chain = chain_tokens(text, 0, len(text))
        if chain.starts:
            rows.append((chain, labels_of(chain, spans)))
    return train(rows)


# ---------------------------------------------------------------------------
# decoding whole texts
# ---------------------------------------------------------------------------

_AT = r"\s?(?:@|[(\[]\s?at\s?[)\]])\s?"
_DOT = r"(?:\s?(?:\.|[(\[]\s?dot\s?[)\]])\s?|\sdot\s)"
#: A bare ``at`` takes bare dots only: "look at www.example.com" is no address.
_EMAIL = re.compile(rf"[\w.%+-]+(?:{_AT}[\w-]+(?:{_DOT}[\w-]+)+|\sat\s[\w-]+(?:\sdot\s[\w-]+)+)", re.I)
_REST = re.compile(r"(?:[\w-]++|(?:\.|\s?+[(\[]\s?+dot\s?+[)\]]\s?+)(?=[\w-]))*+", re.I)


def _completed(text: str, start: int, end: int, floor: int) -> tuple[int, int]:
    """An address with the rest of its local part (from ``floor``) and of its host."""
    while start > floor and _BACK.match(text, start - 1):
        start -= 1
    return start, _REST.match(text, end).end()


def _valid(kind: str, value: str) -> bool:
    digits = _ascii_digits(value)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(digits) <= 15 and not any(c.isalpha() for c in value)
    if kind == "ip":
        parts = re.findall("[0-9]+", value)
        return len(parts) == 4 and _octets(parts) and not any(c.isalpha() for c in value)
    return bool(_EMAIL.fullmatch(value))


_CELLS_AT_ONCE = 60_000


def added_spans(texts: list[str], base: list[list[Span]], model: CRF) -> list[list[Span]]:
    """Spans of the field beside the base spans, for each text."""
    todo = [(i, c) for i, t in enumerate(texts) for a, b in chains(t) if (c := chain_tokens(t, a, b)).starts]
    todo.sort(key=lambda x: len(x[1].starts))
    out: list[list[Span]] = [[] for _ in texts]
    at = 0
    while at < len(todo):
        end, longest = at + 1, len(todo[at][1].starts)
        while end < len(todo) and (end - at + 1) * len(todo[end][1].starts) <= _CELLS_AT_ONCE:
            longest, end = len(todo[end][1].starts), end + 1
        group = todo[at:end]
        for (i, chain), labels in zip(group, model.viterbi([c for _, c in group])):
            k, last = 0, 0
            while k < len(labels):
                if labels[k] == 0 or chain.starts[k] < last:
                    k += 1
                    continue
                kind, j = KINDS[(labels[k] - 1) // 2], k + 1
                while j < len(labels) and labels[j] == labels[k] + 1:
                    j += 1
                a, b = chain.starts[k], chain.ends[j - 1]
                if kind == "email" and _valid(kind, texts[i][a:b]):
                    a, b = _completed(texts[i], a, b, last)
                if all(b <= s or a >= e for _, s, e in base[i]) and _valid(kind, texts[i][a:b]):
                    out[i].append((kind, a, b))
                    last = b
                k = j
        at = end
    return out


def join_spans(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one, named by the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def pii_column(text: str, model: CRF, masked: bool = False) -> Column:
    """Struct of a text column: ``base`` and ``spans`` (``kind:start:end``, comma-joined),
    base counts ``n_<kind>``, and with ``masked`` the masked text.

    A null text has no spans and stays null when masked; an empty one stays empty.
    """
    fields = "base string, spans string, " + ", ".join(f"n_{k} long" for k in KINDS) + ", masked string" * masked

    @F.pandas_udf(fields)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            raw = [t if isinstance(t, str) else None for t in series]
            texts = [t or "" for t in raw]
            base = [base_spans(t) for t in texts]
            every = [b + a for b, a in zip(base, added_spans(texts, base, model))]
            out = pd.DataFrame({"base": list(map(join_spans, base)), "spans": list(map(join_spans, every))})
            for k in KINDS:
                out[f"n_{k}"] = np.array([sum(s[0] == k for s in b) for b in base], dtype=np.int64)
            if masked:
                out["masked"] = pd.Series([None if t is None else mask(t, s) for t, s in zip(raw, every)], dtype=object)
            yield out

    return find(F.col(text))
