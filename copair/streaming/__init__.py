"""The reference is a batch analysis and has no streaming.  The E-step
operators are map-only, so fitted models can score a stream of new pairs
unchanged: see ``score_pairs``."""

from copair.streaming.score import score_pairs  # noqa: F401
