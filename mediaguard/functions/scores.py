"""Score algebra: logits, probabilities, the shipped combination and its wording."""
from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from mediaguard import fixed

SHIFT = math.log(fixed.OPERATING_POINT / (1 - fixed.OPERATING_POINT))


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def sigmoid(z) -> Column:
    return 1.0 / (1.0 + F.exp(-_c(z)))


def logit(p, eps: float = 1e-6) -> Column:
    q = F.greatest(F.least(_c(p), F.lit(1 - eps)), F.lit(eps))
    return F.ln(q / (1 - q))


def platt(s, a, b) -> Column:
    a = a if isinstance(a, Column) else F.lit(float(a))
    b = b if isinstance(b, Column) else F.lit(float(b))
    return sigmoid(a * _c(s) + b)


def shifted(z) -> Column:
    """Probability on the emitted scale, where 0.5 is the operating point."""
    return sigmoid(_c(z) - SHIFT)


def shipped(general, tampered=None, face=None) -> Column:
    """The one definition of the emitted score.

    General and tampered compete as logits and pass one sigmoid.  The face probability is
    already on the emitted scale; an absent face must not raise the maximum, so it fills 0.
    """
    z = _c(general)
    if tampered is not None:
        z = F.greatest(z, fixed.TAMPERED_SCALE * _c(tampered))
    p = shifted(z)
    return p if face is None else F.greatest(p, F.coalesce(_c(face), F.lit(0.0)))


def verdict2(p) -> Column:
    return F.when(_c(p) >= fixed.VERDICT_CUT, "AI").otherwise("real")


def verdict3(p) -> Column:
    return (F.when(_c(p) >= fixed.AI_CUT, "likely_ai")
            .when(_c(p) <= fixed.REAL_CUT, "likely_real").otherwise("uncertain"))


def reliability_score(confidence, general, face) -> Column:
    """Distance from one half, blended with how far general and face agree (fully, without a face)."""
    agreement = F.when(_c(face).isNotNull(), 1.0 - F.abs(_c(general) - _c(face))).otherwise(1.0)
    decisive = 2.0 * F.abs(_c(confidence) - 0.5)
    return fixed.RELIABILITY_DECISIVENESS * decisive + fixed.RELIABILITY_AGREEMENT * agreement


def reliability(confidence, general, face) -> Column:
    s = reliability_score(confidence, general, face)
    return F.when(s > fixed.RELIABILITY_HIGH, "high").when(s > fixed.RELIABILITY_MEDIUM, "medium").otherwise("low")


def percent(p) -> Column:
    return F.concat(F.bround(_c(p) * 100, 0).cast("int").cast("string"), F.lit("%"))


def explanation(verdict, general, tampered, face, content) -> Column:
    """Sentence naming the branch that drove the verdict; the first branch wins a tie."""
    names = list(zip(fixed.BRANCH_TITLES, (_c(general), _c(tampered), _c(face)), range(3)))
    present = F.filter(
        F.array(*[F.struct(s.alias("s"), F.lit(-i).alias("o"), F.lit(n).alias("n"))
                  for n, s, i in names]), lambda e: e["s"].isNotNull())
    top = F.array_max(present)
    low = F.array_min(F.transform(
        present, lambda e: F.struct(e["s"].alias("s"), (-e["o"]).alias("o"), e["n"].alias("n"))))
    return (F.when(_c(verdict) == "likely_ai",
                   F.format_string(fixed.EXPLAIN_AI, top["n"], percent(top["s"]), _c(content)))
            .when(_c(verdict) == "likely_real", F.format_string(fixed.EXPLAIN_REAL, low["n"], percent(1 - low["s"])))
            .otherwise(F.format_string(fixed.EXPLAIN_UNSURE, _c(content))))


def noisy_or(*ps) -> Column:
    miss = F.lit(1.0)
    for p in ps:
        miss = miss * (1.0 - F.coalesce(_c(p), F.lit(0.0)))
    return 1.0 - miss


def px_feature(px, mu, sd) -> Column:
    mu = mu if isinstance(mu, Column) else F.lit(float(mu))
    sd = sd if isinstance(sd, Column) else F.lit(float(sd))
    return (F.log2(F.greatest(_c(px).cast("double"), F.lit(1.0))) - mu) / sd
