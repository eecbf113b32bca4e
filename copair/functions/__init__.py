"""Column expressions: residue encoding and probability helpers."""

from copair.functions.alphabet import (  # noqa: F401
    ALPHA_PATH,
    ALPHABET,
    CONSTANT_ALPHA,
    CONSTANT_PROB,
    DFMAX,
    GAP,
    L1_RATIO,
    N_AA,
    N_CODES,
    PC_ALT,
    PC_NULL,
    encode_expr,
    one_hot_expr,
    project_expr,
)
from copair.functions.prob import (  # noqa: F401
    coin_expr,
    harden_expr,
    logloss_expr,
    mcc_expr,
    posterior_expr,
    unit_uniform_expr,
)
