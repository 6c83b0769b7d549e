"""Quality rules per document, and their failure rates per host.

Rules run on every text. Their failures are summed by host (map-side first, so a
host with a third of all rows sends a few numbers per task), each host's rate is
shrunk towards the corpus by a beta prior fitted to all hosts' rates, and hosts
whose shrunken rate is too high lose all their documents. Host verdicts join back
without a hint: Spark broadcasts the host table under its own threshold and splits
hot partitions beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velospan.llm.columns import BLANKS, require, unused, whole_text, words
from velospan.staging import staged

MIN_WORDS = 50
REPEAT_PERCENT = 50
# The characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: A host is refused from this expected share of failing documents.
HOST_LIMIT = 0.8
#: Prior strength where hosts do not differ more than chance lets them.
MAX_STRENGTH = 1000.0
#: Bits of a packed value that hold a window's place in its text.
_PLACE_BITS = 25


def _pinned(value: Column) -> Column:
    """``value``, tied to the row number: Spark computes it where it stands.

    Otherwise a filter on the counts would be moved below them, and their expressions
    written out again for every use of each of them.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def with_rule_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` and ``n_repeat_words``.

    Null texts count as empty. Three-word windows are hashed and sorted together with
    their place in one long each; equal neighbours are then compared word by word, so
    a shared hash alone counts as nothing. A text may have up to 2**25 words.
    Every step is a column of its own, so that none is computed twice.
    """
    whole, tokens, windows, near, places, lines = (unused(docs, f"_rule_{i}") for i in range(6))
    place = F.lit((1 << _PLACE_BITS) - 1)

    def word(at: Column, step: int) -> Column:
        return F.get(F.col(tokens), at.bitwiseAND(place).cast("int") + step)

    def packed(i: Column) -> Column:
        window = F.xxhash64(*[F.get(F.col(tokens), i + step) for step in range(3)])
        return F.shiftleft(window, _PLACE_BITS).bitwiseOR(i.cast("long"))

    def beside(name: str, same):
        """Members of a sorted array that equal the one before or behind them."""

        def kept(x: Column, i: Column) -> Column:
            after = F.coalesce(same(x, F.get(F.col(name), i + 1)), F.lit(False))
            return after | ((i > 0) & F.coalesce(same(x, F.get(F.col(name), F.greatest(i - 1, F.lit(0)))), F.lit(False)))

        return F.filter(F.col(name), kept)

    def equal_words(x: Column, y: Column) -> Column:
        return (word(x, 0) == word(y, 0)) & (word(x, 1) == word(y, 1)) & (word(x, 2) == word(y, 2))

    none = F.array().cast("array<bigint>")
    indexes = F.sequence(F.lit(0), F.greatest(F.size(tokens) - 3, F.lit(0)))
    steps = F.transform(places, lambda x, i: F.least(F.coalesce(F.get(F.col(places), i + 1) - x, F.lit(3)), F.lit(3)))
    staged_columns = docs.withColumn(whole, whole_text(text))
    staged_columns = staged_columns.withColumns({
        tokens: _pinned(words(F.col(whole))),
        lines: _pinned(F.filter(F.split(whole, "\n", -1), lambda line: F.trim(line, F.lit(BLANKS)) != "")),
    })
    sorted_windows = F.sort_array(F.transform(indexes, packed))
    staged_columns = staged_columns.withColumn(windows, _pinned(F.when(F.size(tokens) > 3, sorted_windows).otherwise(none)))
    same_hash = lambda x, y: F.shiftright(x, _PLACE_BITS) == F.shiftright(y, _PLACE_BITS)
    staged_columns = staged_columns.withColumn(near, _pinned(beside(windows, same_hash)))
    kept_places = F.transform(beside(near, equal_words), lambda x: x.bitwiseAND(place))
    staged_columns = staged_columns.withColumn(places, _pinned(F.sort_array(kept_places)))
    counted = staged_columns.withColumns({
        "n_words": F.size(tokens).cast("long"),
        "word_chars": F.length(F.translate(whole, BLANKS, "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x),
    })
    return counted.drop(whole, tokens, windows, near, places, lines)


def failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > REPEAT_PERCENT * n_words)


def host_verdicts(hosts: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """Add ``rate`` (shrunken) and ``host_kept`` to one row per host with ``n_docs`` and ``n_failed``.

    The prior is the beta distribution with the mean and variance of the hosts' raw
    rates, the latter less what chance alone would give. Without hosts there is no
    row; one host alone has no variance and is shrunk to its own mean.
    """
    n, k = F.col("n_docs"), F.col("n_failed")
    own = hosts.filter(n > 0)
    # One row of sums over hosts, whatever the number of hosts.
    sums = own.agg(
        F.count("*").alias("hosts"),
        F.sum(n).alias("docs"),
        F.sum(k).alias("failed"),
        F.avg(k / n).alias("mean"),
        F.var_pop(k / n).alias("variance"),
        F.avg(1 / n).alias("inverse"),
    ).first()
    mean = float(sums["failed"] or 0) / max(float(sums["docs"] or 0), 1.0)
    spread = mean * (1 - mean)
    between = float(sums["variance"] or 0) - spread * float(sums["inverse"] or 0)
    strength = min(MAX_STRENGTH, max(1.0, spread / between - 1)) if between > 0 else MAX_STRENGTH
    rate = (k + mean * strength) / (n + strength)
    return hosts.withColumn("rate", rate).withColumn("host_kept", F.col("rate") < limit)


def host_table(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """Documents and failures per host; a null host is a host of its own."""
    base = with_rule_counts(docs.select(F.col(host).alias("host"), F.col(text).alias("text")))
    bad = failed(F.col("n_words"), F.col("n_repeat_words")).cast("long")
    return base.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(bad).alias("n_failed"))


def host_rules(docs: DataFrame, host: str = "source", text: str = "text", limit: float = HOST_LIMIT) -> DataFrame:
    """Every row of ``docs`` with its counts, ``base_failed`` and ``kept``.

    Rows come back once each, whatever repeats or nulls they hold; columns of
    ``docs`` that carry one of the new names are replaced. A null or empty text has
    no words and fails. An empty table gives an empty table.
    """
    require(docs, host, text)
    verdicts = host_verdicts(staged(host_table(docs, host, text), "host-failures"), limit).select("host", "host_kept")
    of_host, verdict = unused(docs, "_host"), unused(docs, "_host_kept")
    judged = with_rule_counts(docs, text)
    judged = judged.withColumn("base_failed", failed(F.col("n_words"), F.col("n_repeat_words")))
    named = verdicts.select(F.col("host").alias(of_host), F.col("host_kept").alias(verdict))
    joined = judged.join(named, judged[host].eqNullSafe(named[of_host]), "left")
    kept = ~F.col("base_failed") & F.coalesce(F.col(verdict), F.lit(True))
    return joined.withColumn("kept", kept).drop(of_host, verdict)


def keep_good(docs: DataFrame, host: str = "source", text: str = "text", limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of ``docs`` that pass the rules and whose host does, with the columns of ``docs``."""
    inputs = docs.select(*[F.col(c).alias(f"in_{i}") for i, c in enumerate(docs.columns)])
    names = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    judged = host_rules(inputs, names[host], names[text], limit)
    return judged.filter("kept").select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(docs.columns)])
