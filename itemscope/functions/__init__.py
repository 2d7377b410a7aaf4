"""Column-expression helpers.  All are built-in Spark expressions (JVM side,
whole-stage codegen); none is a Python UDF."""

from itemscope.functions.columns import (  # noqa: F401
    argmax_array,
    broadcast_scalar,
    exp_shifted,
    normalise,
    with_softmax,
    avg_rank,
    clip,
    hex_uniform,
    item_curve,
    md5_key,
    ntz_epoch_micros,
    ntz_to_instant,
    r6,
    r12,
    sigmoid,
    softmax_array,
    sum_array,
)
