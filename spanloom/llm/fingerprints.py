"""Document fingerprints by consistent weighted sampling, in DataFrame expressions only.

A document is a set of words, each weighted by how often it occurs. For every sample and word, three
variates that depend on nothing but sample and word (r and c from Gamma(2, 1), b uniform) turn the
weight w into a quantised weight and a race time:

    t = floor(ln w / r + b),  ln a = ln c - r (t - b + 1)

The sample of a document is the (word, t) with the smallest a. Two documents agree in a sample with
probability sum of min(w, w') / sum of max(w, w'), the generalised Jaccard similarity, so the share
of agreeing samples estimates it.

At scale: the words of a text are counted inside its row and their samples are reduced to one row
per text where the text lies; nothing is shuffled for it, and a reducer holds a few numbers per text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLES = 32
SPACE = r"[\x20\x09-\x0D]+"
LOW = (1 << 32) - 1


def weighted_terms(text: Column) -> Column:
    """Sorted hashes of the lower-case words of `text`, one for each time a word occurs."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != "")
    return F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))


def _counted(hashes: Column, starts: Column) -> Column:
    """(term, weight) from sorted hashes and the places (from 1) where a new one starts."""
    after = lambda i, k: F.coalesce(F.get(starts, k + 1), F.size(hashes) + 1)
    return F.transform(starts, lambda i, k: F.struct(F.element_at(hashes, i).alias("term"), (after(i, k) - i).alias("weight")))


def _uniform(bits: Column, shift: int, width: int) -> Column:
    """From `width` bits of a hash, in (0, 1)."""
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1).cast("bigint")).cast("double") + 0.5) * (0.5**width)


def _sample(number: int, term: Column, log_weight: Column) -> Column:
    """Race time in the high 31 bits, identity of (term, t) in the low 32."""
    first, second = F.xxhash64(term, F.lit(2 * number)), F.xxhash64(term, F.lit(2 * number + 1))
    r = -F.ln(_uniform(first, 0, 32) * _uniform(first, 32, 32))
    log_c = F.ln(-F.ln(_uniform(second, 0, 24) * _uniform(second, 24, 20)))
    b = _uniform(second, 44, 20)
    t = F.floor(log_weight / r + b)
    # ln a lies in (-82, 4) for weights up to 2^31: ln c in (-15, 4), r in (0, 46).
    time = F.shiftleft(((log_c - r * (t - b + 1.0) + 96.0) * float(1 << 23)).cast("bigint"), 32)
    return time.bitwiseOR(F.xxhash64(term, t).bitwiseAND(F.lit(LOW)))


def signatures(df: DataFrame, text: str, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """`keys` and `_signature` (array of `samples` BIGINT, 0 to 2^32 - 1) of each row's text.

    `keys` must tell the rows apart. If `df` is partitioned by a part of them, nothing is shuffled.
    Null texts are empty; a text without words has the signature of zeros.
    """
    df = df.select(*keys, weighted_terms(F.col(text)).alias("_hashes"))
    starts = F.filter(F.sequence(F.lit(1), F.size("_hashes")), lambda i: (i == 1) | (F.element_at("_hashes", i) != F.element_at("_hashes", i - 1)))
    df = df.withColumn("_starts", F.when(F.size("_hashes") > 0, starts))
    df = df.select(*keys, F.explode_outer(_counted(F.col("_hashes"), F.col("_starts"))).alias("_t"))
    df = df.select(*keys, F.col("_t.term").alias("_term"), F.ln(F.col("_t.weight").cast("double")).alias("_log"))
    least = df.groupBy(*keys).agg(*[F.min(_sample(j, F.col("_term"), F.col("_log"))).alias(f"_m{j}") for j in range(samples)])
    return least.select(*keys, F.array(*[F.coalesce(F.col(f"_m{j}").bitwiseAND(F.lit(LOW)), F.lit(0)) for j in range(samples)]).alias("_signature"))


def fingerprint(signature: Column, samples: int = SAMPLES) -> Column:
    """Eight hex digits a sample."""
    return F.concat(*[F.lower(F.lpad(F.hex(F.get(signature, F.lit(j))), 8, "0")) for j in range(samples)])


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of samples in which two signatures agree: estimates the generalised Jaccard similarity."""
    agree = [F.when(F.get(a, F.lit(j)) == F.get(b, F.lit(j)), 1).otherwise(0) for j in range(samples)]
    total = agree[0]
    for one in agree[1:]:
        total = total + one
    return total / F.lit(float(samples))
