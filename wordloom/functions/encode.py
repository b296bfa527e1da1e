"""Training-row encoding: time tokens, window texts, padding, losses and the learning-rate schedule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ids of the window tokens, in the order in which they were added.
RIGHT_ID, MID_ID, LEFT_ID = 51907, 51908, 51909
MAX_LABELS = 256
IGNORED = -100


def round_down_02(seconds: Column) -> Column:
    """Down to a multiple of 0.02 in double arithmetic; the integer form differs on some values."""
    return F.round(F.floor(seconds / F.lit(0.02)) * F.lit(0.02), 2)


def time_token(seconds: Column) -> Column:
    return F.format_string("<|%.2f|>", seconds)


def sample_index(ms: Column, rate: int = 16_000) -> Column:
    return (ms / F.lit(1000) * F.lit(rate)).cast("bigint")


def _offset(ms: Column, start: Column) -> Column:
    return round_down_02((ms - start) / F.lit(1000))


def _given(ms: Column) -> Column:
    return ms.isNotNull() & (ms != 0)


def _parts(text: Column) -> list[Column]:
    pieces = F.split(text, r"\|", -1)
    return [F.get(pieces, i) for i in range(3)]


def is_windowed(text: Column) -> Column:
    """Whether a text has exactly two window bars."""
    return F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit(""))) == 2


def windowed_text(text: Column, start: Column, lend: Column, mstart: Column, mend: Column, rstart: Column, rend: Column) -> Column:
    """left, mid and right of a text with two bars in the windowed layout. Zero and null times are missing, before
    rounding and, as the left end decides, after it."""
    left, mid, right = (F.trim(p) for p in _parts(text))
    middle = lambda ms: time_token(_offset(ms, start))
    mst, met = middle(mstart), middle(mend)
    left_time = F.when(_given(lend), _offset(lend, start))
    let = F.when(left_time.isNotNull() & (left_time != 0), time_token(left_time)).otherwise("<|0.00|>")
    rst = F.when(_given(rstart), middle(rstart)).otherwise(met)
    ret = F.when(_given(rend), middle(rend)).otherwise(met)
    return F.concat(F.lit("<|left|><|0.00|>"), left, F.lit(" "), let, let, F.lit("<|mid|><|startoftranscript|><|notimestamps|>"), mst, mst, mid, F.lit(" "), met, met, F.lit("<|endoftext|><|right|>"), rst, rst, right, ret, ret)


def plain_text(text: Column, start: Column, end: Column, mstart: Column, rstart: Column) -> Column:
    """The same text as one run with doubled time tokens where mid and right begin."""
    left, mid, right = _parts(text)
    left, right = F.ltrim(left), F.rtrim(right)
    mst = time_token(_offset(mstart, start))
    right_time = F.when(_given(rstart), _offset(rstart, start))
    rst = time_token(right_time)
    mid = F.when(F.trim(left) != "", F.concat(mst, mst, mid)).otherwise(mid)
    mid = F.when(right_time.isNotNull() & (right_time != 0), F.concat(mid, rst, rst)).otherwise(mid)
    body = F.replace(F.trim(F.concat(left, F.lit(" "), mid, F.lit(" "), right)), F.lit("  "), F.lit(" "))
    last = time_token(_offset(end, start))
    return F.concat(F.lit("<|0.00|>"), body, last, last)


def hashed_ids(text: Column, vocabulary: int = 50_000) -> Column:
    """Stand-in tokenizer: a hash of each white-space token. Any column of id arrays fits in its place."""
    return F.transform(F.filter(F.split(text, r"\s+"), lambda t: t != ""), lambda t: F.pmod(F.xxhash64(t), F.lit(vocabulary)).cast("int"))


def truncate(ids: Column, most: int = MAX_LABELS) -> Column:
    return F.slice(ids, 1, most)


def drop_for_plain(ids: Column) -> Column:
    """Without the id at index 1."""
    return F.concat(F.slice(ids, 1, 1), F.slice(ids, 3, F.greatest(F.size(ids), F.lit(1))))


def drop_for_windowed(ids: Column) -> Column:
    """Without the first two ids and the last."""
    return F.slice(ids, 3, F.greatest(F.size(ids) - 3, F.lit(0)))


def shift_right(ids: Column, start_id: Column | int, ignored: int = IGNORED, pad_id: int = 0) -> Column:
    """start_id, then all but the last; ignored labels become padding."""
    start = F.lit(start_id) if isinstance(start_id, int) else start_id
    moved = F.concat(F.array(start.cast("int")), F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0))))
    return F.transform(moved, lambda i: F.when(i == ignored, F.lit(pad_id)).otherwise(i))


def pad_labels(ids: Column, length: Column) -> Column:
    """ids up to length, the rest ignored."""
    return F.concat(ids, F.array_repeat(F.lit(IGNORED), F.greatest(length - F.size(ids), F.lit(0)).cast("int")))


def mid_mask(ids: Column) -> Column:
    """True from the first mid token to before the first right token, on labels that count; nothing without a right token."""
    first, last = F.array_position(ids, MID_ID), F.array_position(ids, RIGHT_ID)
    return F.transform(ids, lambda x, i: (x >= 0) & (i + 1 >= first) & (i + 1 < last) & (first > 0))


def log_sum_exp(logits: Column) -> Column:
    """The logarithm of the sum of exponentials, with the largest logit taken out first."""
    top = F.array_max(logits).cast("double")
    return top + F.log(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x.cast("double") - top)))


def log_softmax_at(logits: Column, target: Column) -> Column:
    """log of the softmax share of the logit at index target."""
    return F.get(logits, target).cast("double") - log_sum_exp(logits)


def smoothed_loss(logits: Column, target: Column, share: float) -> Column:
    """Cross-entropy against a target that gives ``share`` to all other classes alike; the entropy of that target, the
    least loss there is, is not taken off."""
    total, n = log_sum_exp(logits), F.size(logits)
    own = total - F.get(logits, target).cast("double")
    others = n * total - F.aggregate(logits, F.lit(0.0), lambda a, x: a + x.cast("double")) - own
    return F.lit(1.0 - share) * own + F.lit(share) / (n - 1) * others


def segmented_loss(nll: Column, labels: Column, mid: Column, penalty: float) -> Column:
    """An aggregate over label rows: the masked loss of those that count, mid rows whole and others by ``penalty``."""
    return masked_loss(F.when(labels >= 0, nll).otherwise(0.0), mid & (labels >= 0), penalty)


def masked_loss(nll: Column, mask: Column, penalty: float = 1.0) -> Column:
    """An aggregate: masked losses plus penalised others, over the size of the mask; null without one."""
    m = mask.cast("double")
    return F.try_divide(F.sum(nll * m) + F.lit(penalty) * F.sum(nll * (1 - m)), F.sum(m))


def smoothing(vocabulary: int, share: float) -> tuple[float, float]:
    """(confidence, low confidence) of smoothed one-hot targets."""
    return 1.0 - share, share / (vocabulary - 1)


def learning_rate(step: Column, peak: float, warmup: int, total: int) -> Column:
    """Linear warm-up to peak, then linear decay to zero at total."""
    rise = step / F.lit(max(1, warmup)) * peak
    fall = F.lit(peak) * (1 - F.least((step - warmup) / F.lit(max(1, total - warmup)), F.lit(1.0)))
    return F.when(step < warmup, rise).otherwise(fall)
