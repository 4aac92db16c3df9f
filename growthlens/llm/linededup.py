"""Line dedup by deletion neighbourhoods and shared runs, in DataFrame operations only.

A line is a word sequence (white space parts words).  A line is removed if an
earlier line - by document id, then line number - lies within the edit bound;
the earliest stays.  Bounds, each by the shorter line:

* words, if both lines have at least ``EDIT_WORDS`` words: one word inserted,
  deleted or replaced, and with ``percent`` that share of the words if it is more.
  A line of ``EDIT_WORDS`` words may also lack one word of it.
* characters, with ``percent`` only, if one of the lines has fewer words (and
  the other fewer than ``CHAR_WORDS``): half that share of the characters.  Text
  without white space is one word, and thus compared this way.

1. Equal lines become one class, known by its earliest place (map-side
   combined minimum; a line that a third of all documents share is one class).
   From here on a line is its class: two hashes and the place.
2. Each line gives a few 64-bit keys.  Where the bound is one edit: its halves, as
   two such lines agree in the first or the last half of the shorter one.  Where it is
   more, for words: the first of all its ``RUN``-word runs in a fixed order, long runs before short ones.  An edit
   touches at most ``RUN`` of them, so ``RUN`` times the bound and k more hold k that both lines have;
   a line with fewer shared keys is set aside, and of the others the k - 1 that most lines hold are no keys.
   For characters: of the hashes of all runs of ``GRAM`` units the least in each window of a few runs
   that follow each other.  Edits within the bound leave a run as long as such a window
   untouched, and both lines choose the same hash in it.  Lines that share no key with another class are set aside.
3. Of the others, those with a bound of one edit emit their deletion neighbourhood as hashed keys: the
   line and every variant with one unit left out.
4. Equal keys are joined by minima per key: each line meets the earliest line of each of its keys.
5. The words of every pair so found are compared, which confirms the edit distance.

6. Lines with a larger bound that no such pair removes meet every earlier line of each of their keys that at most
   ``GROUP`` lines hold.  All lines of the other keys meet by the rarest of all their runs: an edit touches at most
   ``GRAM`` runs, so ``GRAM`` times the bound and one more hold the rarest run that both lines have.  A heading or
   template of many lines is thus a key only for lines that hold little else.  Lines that so meet are a pair if the
   parities of their units allow it: each unit turns one of 256 bits, so an edit turns at most two.

The result is exact: no key drops a partner.

Defined cases: null text counts as empty and stays null; blank lines stay; an
empty table gives no rows; rows with equal id and equal text count as one
document, and null ids come first; columns of the input stay as they are, whatever
their names (but ``n_lines`` and ``n_removed`` are replaced).  Texts and lines of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from growthlens.llm import common

MIN_WORDS = 1
EDIT_WORDS, CHAR_WORDS = 8, 10
#: Share of a line's words that may differ in the registered query and the pipeline.
EDIT_PERCENT = 10
#: Units of a run that is hashed, at most; a run that edits within the bound leave untouched is no shorter.
GRAM = {"word": 3, "char": 10}
#: Words of a run that is a key, and lines of a key that all meet each other.
RUN, GROUP = 2, 32
#: Numbers of 64 bits that hold the parities of a line's units.
PARITIES = 4


def _plain(line: Column) -> Column:
    """A line's words, one blank between them."""
    odd = line.startswith(" ") | line.endswith(" ") | line.contains("  ")
    for c in "\t\r\x0B\f":
        odd = odd | line.contains(c)
    return F.when(odd, F.trim(F.regexp_replace(line, r"[ \t\r\x0B\f]+", " "))).otherwise(line)


def _document_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, also inside lambdas."""
    return F.transform(F.array(value), use)[0]


def _half_keys(units: Column, kind: str) -> Column:
    """Keys of the halves: prefix and suffix that a line shares with any line one edit away, by the shorter one's length."""
    n = F.size(units)

    def halves(m: Column) -> list[Column]:
        h = F.floor(m / 2).cast("int")
        part = lambda at, size: F.xxhash64(F.lit(kind), m, at == 1, F.array_join(F.slice(units, at, size), " "))
        return [part(F.lit(1), h), part(n - (m - h) + 1, m - h)]
    return F.array(*halves(n), *halves(n - 1))


def _size(text: Column, kind: str) -> Column:
    """Units of a text."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit(""))) + 1 if kind == "word" else F.char_length(text)


def _gram(kind: str, percent: int) -> int:
    """Units of a hashed run."""
    return min(GRAM[kind], _untouched(kind, percent, 2))


def _untouched(kind: str, percent: int, edits: int) -> int:
    """Units of the longest run that a line whose bound is ``edits`` or more shares with any line within its bound, at least.

    Of n units t edits leave n - t in t + 1 runs, with t at most a share of n; this grows with n.
    """
    whole = 100 if kind == "word" else 200
    return -(-edits * (whole - percent) // (percent * (edits + 1)))


def _grams(units: Column, kind: str, percent: int) -> Column:
    """Hashes of all runs of units, in order."""
    size = _gram(kind, percent)
    return F.transform(F.sequence(F.lit(1), F.size(units) - size + 1), lambda i: F.xxhash64(F.lit(kind), F.slice(units, i, F.lit(size))))


def _window_keys(units: Column, kind: str, percent: int) -> Column:
    """The least hash in each window of runs; windows are wider where every line within the bound has a bound of four edits."""
    wide = -(-4 * (100 if kind == "word" else 200) // percent)
    at_least = lambda edits: F.lit(_untouched(kind, percent, edits) - _gram(kind, percent) + 1)
    many = F.when(F.size(units) < wide + _bound(F.lit(wide), kind, percent), at_least(2)).otherwise(at_least(4))
    return _let(_grams(units, kind, percent), lambda g: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(g) - many + 1), lambda i: F.array_min(F.slice(g, i, many)))))


def _further(bound: Column) -> Column:
    """Keys of a line beyond the fewest that hold one which a line within ``bound`` edits has too."""
    return bound


def _run_keys(units: Column, percent: int) -> Column:
    """The first runs of ``RUN`` words, repeats counted, by a hash whose upper bits put long runs before short ones."""
    def key(a, b):
        size = F.least(F.octet_length(a) + F.octet_length(b), F.lit((1 << 15) - 1))
        return F.xxhash64(a, b).bitwiseAND(F.lit((1 << 48) - 1)) - F.shiftleft(size.cast("long"), 48)
    n = F.size(units)
    bound = _bound(n, "word", percent)
    runs = F.zip_with(F.slice(units, F.lit(1), n - 1), F.slice(units, F.lit(RUN), n - 1), key)
    return F.slice(F.sort_array(runs), F.lit(1), RUN * bound + 1 + _further(bound))


def _parities(units: Column) -> Column:
    """``PARITIES`` numbers of 64 bits; each unit turns one bit."""
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 8).bitwiseAND(F.lit(63)).cast("int"))
    turned = lambda k: lambda s, h: F.when(F.pmod(h, F.lit(PARITIES)) == k, s.bitwiseXOR(bit(h))).otherwise(s)
    return _let(F.transform(units, lambda u: F.xxhash64(u)), lambda hashes: F.array(*(F.aggregate(hashes, F.lit(0).cast("long"), turned(k)) for k in range(PARITIES))))


def _variants(units: Column) -> Column:
    """array<struct<left_out, key>>: all units (left_out 0) and every variant without unit i (from 1)."""
    here = lambda w, i: F.xxhash64(w, i)
    total = F.aggregate(F.transform(units, lambda w, i: here(w, i)), F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))
    shifted = F.aggregate(F.transform(units, lambda w, i: here(w, i - 1)), F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))
    moved = F.transform(units, lambda w, i: F.struct(here(w, i).alias("a"), here(w, i - 1).alias("b")))
    start = F.struct(shifted.alias("run"), F.array().cast("array<bigint>").alias("keys"))
    # run = hashes of the units before i at their places, of i and those after it one place to the left
    keys = F.aggregate(moved, start, lambda s, m: F.struct(
        s["run"].bitwiseXOR(m["b"]).bitwiseXOR(m["a"]).alias("run"),
        F.concat(s["keys"], F.array(s["run"].bitwiseXOR(m["b"]))).alias("keys")))["keys"]
    return F.concat(
        F.array(F.struct(F.lit(0).alias("left_out"), total.alias("key"))),
        F.transform(keys, lambda k, i: F.struct((i + 1).alias("left_out"), k.alias("key"))),
    )


def _bound(size: Column, kind: str, percent: int) -> Column:
    """Edits by which a line of ``size`` units may differ from a longer one."""
    if kind == "char":
        return F.floor(size * percent / 200).cast("int")
    return F.greatest(F.lit(1), F.floor(size * percent / 100)).cast("int")


def _codes(units: Column) -> Column:
    """Two texts with one character for each unit, by hash; edit distances of units are those of such texts."""
    point = lambda h, bits: F.concat(F.lit("000"), F.hex(F.pmod(F.shiftright(h, bits), F.lit(15 << 16)) + (1 << 16)))
    text = lambda hashes, bits: F.decode(F.unhex(F.array_join(F.transform(hashes, lambda h: point(h, bits)), "")), "UTF-32")
    return _let(F.transform(units, lambda u: F.xxhash64(u)), lambda hashes: F.struct(text(hashes, 0).alias("one"), text(hashes, 32).alias("two")))


def _lines(texts: DataFrame) -> DataFrame:
    """(doc, id, line_no, line, n, h, g) of every line that takes part; ``line`` has one blank between its ``n`` words."""
    # blank lines go before their words are looked at, so that this is done once
    lines = (
        texts.select("doc", "id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.col("line").rlike(r"[^ \t\r\x0B\f]"))
        .select("doc", "id", "line_no", _plain(F.col("line")).alias("line"))
        .withColumns({"n": _size(F.col("line"), "word"), "h": F.xxhash64("line"), "g": F.hash("line")})
    )
    return lines if MIN_WORDS <= 1 else lines.where(F.col("n") >= MIN_WORDS)


def _keys(kind: str, percent: int) -> Column:
    """Keys of a line (``line`` of ``n`` words) in one kind of units; null where nothing may differ."""
    line, size = F.col("line"), F.col("n") if kind == "word" else F.char_length("line")
    takes_part = F.col("n") >= EDIT_WORDS - 1 if kind == "word" else (F.col("n") < CHAR_WORDS) & (_bound(size, kind, percent) > 0)
    units = F.split(line, " " if kind == "word" else "")
    halves = F.when(_bound(size - 1, kind, percent) <= 1, _let(units, lambda u: _half_keys(u, kind)))
    several = (lambda u: _run_keys(u, percent)) if kind == "word" else (lambda u: _window_keys(u, kind, percent))
    runs = F.when(_bound(size, kind, percent) > 1, _let(units, several)) if percent else F.lit(None).cast("array<bigint>")
    return F.when(takes_part, F.struct(halves.alias("halves"), runs.alias("runs")))


def _open(kind: str, place: str = "place") -> Column:
    """Whether a line may pair with every other one that takes part; the rest pair with such lines only."""
    return F.lit(True) if kind == "word" else F.col(f"{place}.n") < EDIT_WORDS


def _held_by_several(rows: DataFrame) -> DataFrame:
    """``rows(h, key, ...)`` without repeats, of the keys that several lines hold, and ``lines``, the rows of the key; one shuffle for all of it."""
    of_key = Window.partitionBy("key")
    shared = rows.withColumns({"lo": F.min("h").over(of_key), "hi": F.max("h").over(of_key)}).where("lo <> hi").drop("lo", "hi").distinct()
    return shared.withColumn("lines", F.count("*").over(of_key))


def _least_held(rows: DataFrame, percent: int) -> DataFrame:
    """Of each line's shared keys ``rows(h, g, n, pos, key, lines)`` all but the ``_further`` ones that most lines hold.

    A line that any partner of its own length or less may lie near shares more keys than those.
    """
    # the least bound of a line within whose bound this one may lie
    least = F.greatest(F.lit(2), F.floor(F.col("n") * percent / (100 + percent)).cast("int"))
    rank = F.row_number().over(Window.partitionBy("h", "g").orderBy(F.desc("lines"), F.desc("key"), F.desc("pos")))
    return rows.withColumn("rank", rank).where(F.col("rank") > _further(least))


def _shared_keys(lines: DataFrame, classes: DataFrame, parts: list[tuple[str, str]], percent: int) -> dict[tuple[str, str], DataFrame]:
    """(place, key) of the keys that several classes hold, by (kind, part); the keys of all kinds and parts go in one pass."""
    rows = None
    for k, (kind, part) in enumerate(parts):
        more = (lines.where(F.col(f"{kind}.{part}").isNotNull())
                .select(F.lit(k).alias("part"), "h", "g", "n", F.posexplode(f"{kind}.{part}").alias("pos", "key")).where("key is not null"))
        rows = more if rows is None else rows.unionByName(more)
    rows = common.written(_held_by_several(rows))
    kept = rows.select("part", "h", "g", "key").distinct()
    if ("word", "runs") in parts:
        runs = F.col("part") == parts.index(("word", "runs"))
        least = _held_by_several(_least_held(rows.where(runs), percent).select("part", "h", "g", "key")).drop("lines")
        kept = kept.where(~runs).unionByName(least)
    kept = common.written(kept)
    word = F.col("part").isin([k for k, (kind, _) in enumerate(parts) if kind == "word"])
    place = F.struct("first.*", "h", "g", "n", F.when(word, F.col("n")).otherwise(F.col("chars")).alias("size"))
    met = common.written(kept.join(classes, ["h", "g"]).select("part", place.alias("place"), "key"))
    return {of: met.where(F.col("part") == k).drop("part") for k, of in enumerate(parts)}


def _meet(rows: DataFrame, kind: str, keys: list[str]) -> DataFrame:
    """(place, lead): each row's line and the earliest line of equal ``keys`` that it may pair with."""
    leads = rows.groupBy(*keys).agg(F.min("place").alias("any"), F.min(F.when(_open(kind), F.col("place"))).alias("open"))
    return rows.join(leads, keys).select("place", F.when(_open(kind), F.col("any")).otherwise(F.col("open")).alias("lead"))


def _near_pairs(known: DataFrame, met: DataFrame, kind: str) -> DataFrame:
    """(place, lead) by the full deletion neighbourhood of lines whose bound is one edit."""
    lines = met.groupBy(*(F.col(f"place.{c}").alias(c) for c in ("h", "g"))).agg(F.first("place").alias("place"))
    rows = common.written(
        lines.join(known, ["h", "g"])
        .select("place", F.explode(_variants(F.split("line", " " if kind == "word" else ""))).alias("v"))
        .select("place", "v.key", "v.left_out")
        # a line just short of EDIT_WORDS words pairs with longer ones only
        .where((F.lit(kind) == "char") | (F.col("place.n") >= EDIT_WORDS) | (F.col("left_out") == 0)))
    several = rows.groupBy("key").agg(F.min("place.h").alias("lo"), F.max("place.h").alias("hi")).where("lo <> hi").select("key")
    rows = common.written(rows.join(common.bounded(common.written(several)), "key", "left_semi"))
    whole, lacking = rows.where("left_out = 0"), rows.where("left_out > 0")
    earliest = lambda df: df.groupBy("key").agg(F.min("place").alias("any"), F.min(F.when(_open(kind), F.col("place"))).alias("open"))
    across = lambda a, b: a.join(earliest(b), "key").select("place", F.when(_open(kind), F.col("any")).otherwise(F.col("open")).alias("lead"))
    return _meet(lacking, kind, ["key", "left_out"]).unionByName(across(whole, lacking)).unionByName(across(lacking, whole))


def _rarest_runs(known: DataFrame, met: DataFrame, kind: str, percent: int) -> DataFrame:
    """Written (place, key) of the rarest runs of each line of ``met`` that several such lines hold.

    Lines within the bound share a run, and the first one they share, by rarity among these lines,
    comes after at most the runs that the edits touch.
    """
    lines = common.written(met.groupBy(*(F.col(f"place.{c}").alias(c) for c in ("h", "g"))).agg(F.first("place").alias("place")))
    units = F.split("line", " " if kind == "word" else "")
    rows = common.written(lines.select("h", "g", "place.size").join(known, ["h", "g"]).select(
        "h", "g", "size", F.explode(_let(units, lambda u: F.array_distinct(_grams(u, kind, percent)))).alias("key")))
    counts = common.written(rows.groupBy("key").agg(F.count("*").alias("lines")).where("lines > 1"))
    rank = F.row_number().over(Window.partitionBy("h", "g").orderBy(F.coalesce("lines", F.lit(1)), "key"))
    rarest = rows.join(common.bounded(counts), "key", "left").withColumn("rank", rank).where(
        (F.col("rank") <= _gram(kind, percent) * _bound(F.col("size"), kind, percent) + 1) & F.col("lines").isNotNull())
    return common.written(rarest.select("h", "g", "key").join(lines, ["h", "g"]).select("place", "key"))


def _far_pairs(known: DataFrame, met: DataFrame, done: DataFrame, kind: str, percent: int) -> DataFrame:
    """(place, lead) of each line not yet ``done(h, g)`` with every earlier line that may lie within a bound of several edits.

    Such lines share a key of ``met``.  Where at most ``GROUP`` lines hold it, they meet by it; all lines of the other keys meet by their rarest runs.
    """
    hot = common.written(met.groupBy("key").agg(F.count("*").alias("lines")).where(F.col("lines") > GROUP).select("key"))
    few = met.join(common.bounded(hot), "key", "left_anti")
    rest = _rarest_runs(known, met.join(common.bounded(hot), "key", "left_semi"), kind, percent)
    units = F.split("line", " " if kind == "word" else "")
    ends = met.select("place.h", "place.g").distinct()
    parities = common.bounded(common.written(known.join(ends, ["h", "g"], "left_semi").select("h", "g", _let(units, _parities).alias("parities"))))
    done = common.bounded(done)
    bound = _bound(F.least("place.size", "lead.size"), kind, percent)
    turned = sum((F.bit_count(F.col("parities")[k].bitwiseXOR(F.col("lead_parities")[k])) for k in range(PARITIES)), F.lit(0))
    near = (F.abs(F.col("place.size") - F.col("lead.size")) <= bound) & (turned <= 2 * bound)

    def before(rows: DataFrame) -> DataFrame:
        rows = rows.join(parities, (F.col("place.h") == parities["h"]) & (F.col("place.g") == parities["g"])).select("key", "place", "parities")
        late = rows.join(done, (F.col("place.h") == done["h"]) & (F.col("place.g") == done["g"]), "left_anti")
        early = rows.select("key", F.col("place").alias("lead"), F.col("parities").alias("lead_parities"))
        return late.join(early, "key").where((F.col("lead") < F.col("place")) & near & (_open(kind) | _open(kind, "lead"))).select("place", "lead")
    return before(few).unionByName(before(rest))


def _confirmed(known: DataFrame, pairs: DataFrame, kind: str, percent: int) -> DataFrame:
    """(h, g) of the later line of each pair (place, lead) that lies within the bound."""
    size = F.least("place.size", "lead.size")
    bound = F.when(F.least("place.n", "lead.n") < EDIT_WORDS, 1).otherwise(_bound(size, kind, percent)) if kind == "word" else _bound(size, kind, percent)
    pairs = common.written(
        pairs.where(F.col("lead").isNotNull() & (F.col("place") != F.col("lead")))
        .select(F.greatest("place", "lead").alias("late"), F.least("place", "lead").alias("early"), bound.alias("bound"))
        .where(F.abs(F.col("late.size") - F.col("early.size")) <= F.col("bound"))
        .select(*(F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("late", "early") for c in ("h", "g")), "bound").distinct())
    codes = (_codes(F.split("line", " ")) if kind == "word"
             else F.struct(F.col("line").alias("one"), F.lit("").alias("two")))
    ends = pairs.select(F.col("late_h").alias("h"), F.col("late_g").alias("g")).unionByName(
        pairs.select(F.col("early_h").alias("h"), F.col("early_g").alias("g"))).distinct()
    coded = common.written(known.join(ends, ["h", "g"], "left_semi").select("h", "g", codes.alias("code")))
    side = lambda name: coded.select(F.col("h").alias(f"{name}_h"), F.col("g").alias(f"{name}_g"), F.col("code").alias(name))
    # two hashes of the units must agree that the lines are near
    near = lambda c: F.call_function("levenshtein", F.col(f"late.{c}"), F.col(f"early.{c}"), F.col("bound")) >= 0
    return (pairs.join(side("late"), ["late_h", "late_g"]).join(side("early"), ["early_h", "early_g"]).where(near("one") & near("two"))
            .select(F.col("late_h").alias("h"), F.col("late_g").alias("g")))


def removed_lines(texts: DataFrame, percent: int = 0) -> DataFrame:
    """(doc, removed array<int>): numbers of the lines to remove from documents ``texts(doc, id, text)``."""
    if not 0 <= percent <= 10:
        raise ValueError("percent is from 0 to 10: beyond that, edits may leave no run of some length untouched")
    kinds = ["word", "char"] if percent else ["word"]
    # texts are split and hashed once; what follows reads these narrow rows
    lines = common.written(_lines(texts).select(
        "doc", "id", "line_no", "h", "g", "n", F.char_length("line").alias("chars"), *(_keys(k, percent).alias(k) for k in kinds)))
    classes = common.written(
        lines.select("h", "g", "n", "chars", F.struct("id", "doc", "line_no").alias("place"))
        .groupBy("h", "g").agg(F.min("place").alias("first"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("n", "chars"))))
    met = _shared_keys(lines, classes, [(kind, part) for kind in kinds for part in ("halves", "runs") if percent or part == "halves"], percent)
    # the words of all lines that share a key are fetched once
    places = [rows.select("place.doc", "place.line_no", "place.h", "place.g") for rows in met.values()]
    wanted = places[0]
    for more in places[1:]:
        wanted = wanted.unionByName(more)
    wanted = common.written(wanted.distinct().groupBy("doc").agg(F.collect_list(F.struct("line_no", "h", "g")).alias("wanted")))
    known = common.written(
        texts.select("doc", "text").join(common.bounded(wanted), "doc")
        .select(F.split("text", "\n").alias("lines"), F.explode("wanted").alias("w"))
        .select("w.h", "w.g", _plain(F.element_at("lines", F.col("w.line_no") + 1)).alias("line")).dropDuplicates(["h", "g"]))
    confirmed = None
    for kind in kinds:
        pairs = _near_pairs(known, met[kind, "halves"], kind)
        if percent:
            pairs = pairs.unionByName(_meet(met[kind, "runs"], kind, ["key"]))
        late = _confirmed(known, pairs, kind, percent)
        confirmed = late if confirmed is None else confirmed.unionByName(late)
    confirmed = common.written(confirmed.distinct())
    if percent:
        # what the earliest line of a key does not remove may lie near a later one
        done = confirmed
        for kind in kinds:
            confirmed = confirmed.unionByName(_confirmed(known, _far_pairs(known, met[kind, "runs"], done, kind, percent), kind, percent))
        confirmed = common.written(confirmed.distinct())
    verdict = common.written(
        classes.join(common.bounded(confirmed.withColumn("late", F.lit(True))), ["h", "g"], "left").where("copies > 1 or late")
        .select("h", "g", "first", F.coalesce("late", F.lit(False)).alias("late")))
    return common.written(
        lines.select("doc", "line_no", "h", "g").join(common.bounded(verdict), ["h", "g"])
        .where(F.col("late") | ~((F.col("first.doc") == F.col("doc")) & (F.col("first.line_no") == F.col("line_no"))))
        .groupBy("doc").agg(F.array_distinct(F.collect_list("line_no")).alias("removed")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 0) -> DataFrame:
    """``docs`` with removed lines taken out of the text, plus ``n_lines`` and ``n_removed`` (replacing columns so named).

    ``percent`` (up to 10) lets the edit bound grow with the line; 0 leaves it at one word.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    texts = docs.select(_document_key(id_col, text_col).alias("doc"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    removed = removed_lines(texts, percent)
    # the caller's columns travel in one struct, so that no name can clash
    row = docs.select(F.struct(*names).alias("row"), _document_key(id_col, text_col).alias("doc"))
    joined = row.join(common.bounded(removed), "doc", "left")
    text, gone = F.col("row")[text_col], F.col("removed")
    lines = F.split(text, "\n")
    left = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains(gone, i)), "\n")
    return joined.select(
        *(F.when(gone.isNull(), text).otherwise(left).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names),
        F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(gone.isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_removed"),
    )


def drop_repeated(docs: DataFrame) -> DataFrame:
    """``docs`` (columns as they came) without removed lines; documents that lose all their words go."""
    names = docs.columns
    return dedup_lines(docs, percent=EDIT_PERCENT).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\s]")).select(*names)
