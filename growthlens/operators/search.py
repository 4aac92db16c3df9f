"""Title search by an inverted index, and many recommendation requests in one pass.

``title_postings`` keeps each different title once and lists it under every
run of one to three characters.  A pattern looks up the rarest of its longest
runs only; what that finds is checked with LIKE, so results equal a scan.

``recommend_many`` answers a table of requests.  Items are scored once.
A request asks for a group of items - all, a category, those whose titles the index finds for a text, or both -
and a price range.  A binary tree over the different prices keeps the best items of each group
and node, cut to the largest ``top_n`` in every task before the shuffle.  A range is at most two
nodes of each level, so a request reads ``top_n`` rows of a number of nodes that grows with the logarithm of the prices,
not the catalog.  Equal questions are answered once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from growthlens.config import GuardrailConfig, ScoringConfig
from growthlens.functions.columns import first_text, norm_category
from growthlens.operators import recommend as RC
from growthlens.session import settle

#: Longest run of characters in the index.
GRAM = 3
#: Width of the buckets in which prices are counted, and parts into which the first cut of a group is dealt.
PRICE_BUCKET, SALTS = 10.0, 32


def _runs(text: Column, size: int) -> Column:
    """The different runs of ``size`` characters of a text."""
    return F.when(F.char_length(text) >= size, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.char_length(text) - size + 1), lambda i: F.substr(text, i, F.lit(size)))))


def title_postings(items: DataFrame) -> DataFrame:
    """(gram, title): every different title under each of its runs of up to ``GRAM`` characters, and under the empty run."""
    titles = items.select("title").where("title is not null").distinct()
    grams = F.concat(F.array(F.lit("")), *(F.coalesce(_runs(F.col("title"), k), F.array()) for k in range(1, GRAM + 1)))
    return titles.select(F.explode(grams).alias("gram"), "title")


def _pattern_grams(q: Column) -> Column:
    """Runs that a title must hold to be LIKE %q%: the longest that the plain parts of ``q`` have."""
    # a backslash makes the next character plain; % and _ part the text
    mark = "\u0001"
    plain = F.regexp_replace(q, r"\\(.)|[%_]", f"{mark}$1{mark}")
    # an escaped character is joined to its neighbours again
    plain = F.regexp_replace(plain, f"{mark}([^{mark}]){mark}", "$1")
    parts = F.split(plain, mark)
    longest = [F.array_distinct(F.flatten(F.transform(parts, lambda p: F.coalesce(_runs(p, k), F.array())))) for k in range(GRAM, 0, -1)]
    chosen = F.array(F.lit(""))
    for grams in reversed(longest):
        chosen = F.when(F.size(grams) > 0, grams).otherwise(chosen)
    return chosen


def matching_titles(patterns: DataFrame, postings: DataFrame) -> DataFrame:
    """(q, title): the titles that are LIKE %q% (case-sensitive; % and _ are wildcards, a backslash escapes) for each different ``q``.

    An empty ``q`` matches every title and a null one none.
    """
    wanted = patterns.select("q").where("q is not null").distinct()
    grams = wanted.select("q", F.explode(_pattern_grams(F.col("q"))).alias("gram"))
    counts = postings.groupBy("gram").agg(F.count("*").alias("titles"))
    # a run that no title holds has no count, and its pattern no match
    rarest = (grams.join(counts, "gram", "left").groupBy("q")
              .agg(F.min(F.struct(F.coalesce("titles", F.lit(0)).alias("titles"), "gram")).alias("least"))
              .where("least.titles > 0").select("q", "least.gram"))
    found = rarest.join(postings, "gram")
    return found.where(F.like(F.col("title"), F.concat(F.lit("%"), F.col("q"), F.lit("%")))).select("q", "title")


def title_search(items: DataFrame, patterns: DataFrame, postings: DataFrame | None = None) -> DataFrame:
    """(pattern_id, parent_asin) of every item whose title is LIKE %q%, for all rows of ``patterns(pattern_id, q)`` at once.

    ``postings`` may be a stored ``title_postings``; else it is made from the items.
    """
    titles = matching_titles(patterns, title_postings(items) if postings is None else postings)
    return patterns.join(titles, "q").join(items.select("title", "parent_asin"), "title").select("pattern_id", "parent_asin")


def _best(rows: DataFrame, group: list[str], limit: Column | int) -> DataFrame:
    """The first ``limit`` rows of each group by score, then id, with their ``rank``.

    Groups are cut in salted parts first (and in every task before the shuffle), so
    that the last cut sees at most SALTS times the limit of a group, however hot it is.
    """
    limit = F.lit(limit) if isinstance(limit, int) else limit
    order = [F.desc("score"), F.asc("parent_asin")]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("parent_asin"), F.lit(SALTS)))
    parts = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*group, "_salt").orderBy(*order))).where(
        (F.col("rank") <= limit) & (F.col("rank") <= RC.TOP_N_MAX)).drop("rank", "_salt")
    return parts.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(
        (F.col("rank") <= limit) & (F.col("rank") <= RC.TOP_N_MAX))


def _shift(value: Column, by: Column) -> Column:
    """``value`` without its last ``by`` bits."""
    return F.call_function("shiftright", value.cast("long"), by.cast("int"))


def _power(of: Column) -> Column:
    """Two to the power ``of``."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), of.cast("int"))


def _price_places(scored: DataFrame, questions: DataFrame) -> DataFrame:
    """(_value, _before, _through, _size, _depth) of each different price and range end.

    ``_before`` and ``_through`` count the different prices below the value and up to it, ``_size`` all of them;
    a binary tree over them has ``_depth`` levels above its leaves.  Values are counted
    within price buckets, which start where the ones before end, so no task orders them all.
    """
    values = scored.where(F.col("price").isNotNull()).select((F.col("price") + 0.0).alias("_value"), F.lit(1).alias("_is_price")).unionByName(
        questions.select(F.explode(F.array("_low", "_high")).alias("_value"), F.lit(0).alias("_is_price")))
    bucket = F.floor(F.least(F.greatest(F.col("_value"), F.lit(-1e15)), F.lit(1e15)) / PRICE_BUCKET).cast("long")
    values = values.groupBy("_value").agg(F.max("_is_price").alias("_is_price")).withColumn("_bucket", bucket)
    buckets = values.groupBy("_bucket").agg(F.sum("_is_price").alias("_prices"))
    starts = buckets.select("_bucket", (F.sum("_prices").over(Window.orderBy("_bucket")) - F.col("_prices")).alias("_start"),
                            F.sum("_prices").over(Window.partitionBy()).alias("_size"))
    through = F.sum("_is_price").over(Window.partitionBy("_bucket").orderBy("_value"))
    return values.withColumn("_within", through).join(starts, "_bucket").select(
        "_value", (F.col("_start") + F.col("_within") - F.col("_is_price")).alias("_before"), (F.col("_start") + F.col("_within")).alias("_through"), "_size",
        F.ceil(F.log2(F.greatest("_size", F.lit(1)))).cast("int").alias("_depth"))


def recommend_many(items: DataFrame, reviews: DataFrame, requests: DataFrame, scoring: ScoringConfig = ScoringConfig(),
                   guard: GuardrailConfig = GuardrailConfig(), as_of=None) -> DataFrame:
    """(request_id, rank, parent_asin, title, price, category, score): the best items of each request.

    ``requests(request_id, q, category, price_min, price_max, top_n)``; request_id is unique.  Null or empty q and category ask for
    everything; null price bounds leave those of ``guard``, each on its own; an item without a price is in every range.
    ``top_n`` (null: 10) is held between 1 and 100.  Guardrails, scores and order are those of ``recommend_top_n``.
    """
    now = RC._now_ms(as_of)
    candidates = RC.sanitize_nonfinite(RC.item_candidates(items, RC.item_stats(reviews)))
    unpriced = guard.override_price_range(float("-inf"), float("inf"))
    shown = first_text(F.col("category"), F.col("main_category")) if "main_category" in candidates.columns else F.col("category")
    scored = candidates.where(F.size(RC.violations_column(candidates, unpriced, now)) == 0).select(
        "parent_asin", "title", "price", "category", norm_category(shown).alias("_group"), RC.score_column(scoring, now).alias("score"))
    scored = settle(scored)
    text = lambda c: F.when(F.col(c) != "", F.col(c))
    wanted = F.when(text("category").isNotNull(), norm_category(F.col("category")))
    asked = requests.select(
        "request_id", F.coalesce(text("q"), F.lit("")).alias("_q"), F.coalesce(F.concat(F.lit("="), wanted), F.lit("*")).alias("_of"),
        # a zero's sign does not matter
        (F.coalesce(F.col("price_min").cast("double"), F.lit(float(guard.price_min))) + 0.0).alias("_low"),
        (F.coalesce(F.col("price_max").cast("double"), F.lit(float(guard.price_max))) + 0.0).alias("_high"),
        F.least(F.greatest(F.coalesce("top_n", F.lit(10)), F.lit(RC.TOP_N_MIN)), F.lit(RC.TOP_N_MAX)).alias("_n"))
    question = ["_q", "_of", "_low", "_high"]
    questions = asked.groupBy(*question).agg(F.max("_n").alias("_n"))

    # the items of each group asked for; with a title text the index leads to titles, titles to items
    titles = matching_titles(asked.where("_q <> ''").select(F.col("_q").alias("q")), title_postings(items))
    shown = ["parent_asin", "title", "price", "category", "score"]
    of = F.explode(F.array_compact(F.array(F.concat(F.lit("="), F.col("_group")), F.lit("*")))).alias("_of")
    grouped = scored.select(F.lit("").alias("_q"), of, *shown).unionByName(titles.join(scored, "title").select(F.col("q").alias("_q"), of, *shown))
    grouped = grouped.join(questions.select("_q", "_of").distinct(), ["_q", "_of"], "left_semi")

    # the best of each group for each price, then for each node of the tree over all prices
    places = _price_places(scored, questions)
    leaves = _best(grouped.withColumn("_value", F.col("price") + 0.0), ["_q", "_of", "_value"], RC.TOP_N_MAX).drop("rank")
    node = lambda level, at: F.struct(level.cast("int").alias("_level"), at.cast("long").alias("_node"))
    unpriced = node(F.lit(-1), F.lit(0))
    leaves = leaves.join(places.select("_value", "_before", "_depth"), "_value", "left")
    above = F.transform(F.sequence(F.lit(0), F.col("_depth")), lambda j: node(j, _shift(F.col("_before"), j)))
    nodes = leaves.select("_q", "_of", *shown, F.explode(F.when(F.col("price").isNull(), F.array(unpriced)).otherwise(above)).alias("_in"))
    tops = _best(nodes.select("_q", "_of", "_in.*", *shown), ["_q", "_of", "_level", "_node"], RC.TOP_N_MAX).withColumnRenamed("rank", "_rank")

    # a price range is a few nodes of the tree: of each level at most the first and the last
    ranges = (questions.join(places.select(F.col("_value").alias("_low"), F.col("_before").alias("_first"), "_depth", "_size"), "_low")
              .join(places.select(F.col("_value").alias("_high"), F.col("_through").alias("_end")), "_high")
              # nothing lies behind the last price, so a range open to the top ends with the tree
              .withColumn("_end", F.when(F.col("_end") < F.col("_size"), F.col("_end")).otherwise(_power(F.col("_depth")))))

    def parts(j: Column) -> Column:
        first, end = _shift(F.col("_first") + _power(j) - 1, j), _shift(F.col("_end"), j)
        return F.array_compact(F.array(F.when((first < end) & (first % 2 == 1), node(j, first)), F.when((first < end) & (end % 2 == 1), node(j, end - 1))))
    asked_nodes = ranges.select(*question, "_n", F.explode(F.concat(F.array(unpriced), F.flatten(F.transform(F.sequence(F.lit(0), F.col("_depth")), parts)))).alias("_in"))
    found = asked_nodes.select(*question, "_n", "_in.*").join(tops, ["_q", "_of", "_level", "_node"]).where(F.col("_rank") <= F.col("_n"))
    answers = _best(found.select(*question, "_n", *shown), question, F.col("_n")).drop("rank").withColumnRenamed("_n", "_most")
    return _best(asked.join(answers, question), ["request_id"], F.col("_n")).select("request_id", "rank", *shown)
