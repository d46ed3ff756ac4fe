"""Array algebra over class scores: probabilities, decoding and row losses.

Every function maps DOUBLE-array columns to a column, so it runs inside the projection that
calls it. ``y`` is the 0-based target class.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from furrow.functions.arrays import array_sum, bind


def softmax(x: Column) -> Column:
    def scaled(top: Column) -> Column:
        powers = F.transform(x, lambda v: F.exp(v - top))
        return bind(array_sum(powers), lambda total: F.transform(powers, lambda v: v / total))

    return bind(F.array_max(x), scaled)


def log_sum_exp(x: Column) -> Column:
    return bind(
        F.array_max(x),
        lambda top: top + F.log(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))),
    )


def log_softmax(x: Column) -> Column:
    return bind(log_sum_exp(x), lambda total: F.transform(x, lambda v: v - total))


def argmax(x: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def log_prob(x: Column, y: Column) -> Column:
    return F.get(x, y) - log_sum_exp(x)


def cross_entropy(x: Column, y: Column, w: Column | None = None) -> Column:
    loss = -log_prob(x, y)
    return loss if w is None else w * loss


def weighted_mean_loss(loss: Column, w: Column) -> Column:
    """Aggregate: mean of already weighted losses, normalised by the weights."""
    return F.sum(loss) / F.sum(w)


def focal_loss(x: Column, y: Column, gamma: float = 2.0, w: Column | None = None, ignore: int | None = None) -> Column:
    """NULL for an ignored target, so that ``avg`` leaves it out."""
    if gamma < 0:
        raise ValueError("gamma must be >= 0")
    lp = log_prob(x, y)
    loss = -F.pow(F.greatest(1.0 - F.exp(lp), F.lit(0.0)), F.lit(float(gamma))) * lp
    loss = loss if w is None else w * loss
    return loss if ignore is None else F.when(y != ignore, loss)


def mean_or_zero(loss: Column) -> Column:
    """Aggregate: mean of the kept losses, 0 if none is kept."""
    return F.coalesce(F.avg(loss), F.lit(0.0))


def balanced_softmax_loss(x: Column, y: Column, counts: Column, w: Column | None = None) -> Column:
    shifted = F.zip_with(x, counts, lambda v, n: v + F.log(F.greatest(n.cast("double"), F.lit(1.0))))
    return cross_entropy(shifted, y, w)


def logit_adjusted_loss(x: Column, y: Column, priors: Column, tau: float = 1.0, w: Column | None = None) -> Column:
    if tau < 0:
        raise ValueError("tau must be >= 0")
    shifted = F.zip_with(x, priors, lambda v, p: v + F.lit(float(tau)) * F.log(F.greatest(p, F.lit(1e-12))))
    return cross_entropy(shifted, y, w)


def distill_loss(student: Column, teacher: Column, y: Column, hard: float = 0.5, temperature: float = 2.0) -> Column:
    """Row loss; the batch value is its plain average."""
    cool = F.transform(student, lambda v: v / temperature)
    warm = F.transform(teacher, lambda v: v / temperature)
    gap = F.zip_with(log_softmax(warm), log_softmax(cool), lambda t, s: F.exp(t) * (t - s))
    return hard * cross_entropy(student, y) + (1.0 - hard) * temperature * temperature * array_sum(gap)


def multitask_loss(main: Column, group: Column, w: float) -> Column:
    return main + F.lit(float(w)) * group


def constrained_logits(x: Column, group_x: Column, compat: Column, w: float = 1.0, eps: float = 1e-6) -> Column:
    """Class scores pulled towards classes that fit the predicted group.

    ``compat`` holds one array per class: the share of each group in that class.
    """
    if eps <= 0:
        raise ValueError("eps must be > 0")

    def fit(probs: Column, shares: Column) -> Column:
        raw = F.transform(shares, lambda v: F.greatest(v, F.lit(0.0)))
        hit = array_sum(F.zip_with(probs, raw, lambda p, s: p * s))
        even = array_sum(probs) / F.size(raw)
        return bind(
            array_sum(raw),
            lambda total: F.when(total > 0, hit / F.greatest(total, F.lit(1e-12))).otherwise(even),
        )

    return bind(
        softmax(group_x),
        lambda probs: F.zip_with(
            x,
            compat,
            lambda v, shares: v + F.lit(float(w)) * F.log(F.greatest(fit(probs, shares), F.lit(eps))),
        ),
    )
