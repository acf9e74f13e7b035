"""Column-level helpers shared by the operators (all JVM-side expressions)."""
from shelfwise.functions.numeric import hash_uniform, round_half_up, safe_div  # noqa: F401
from shelfwise.functions.positions import dense_position, exact_quantile, exact_quantiles  # noqa: F401
