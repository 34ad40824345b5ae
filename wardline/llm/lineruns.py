"""Operator 4. Line dedup by a suffix array over line ids, built by distributed prefix doubling (native).

Lines are split at line feeds and trimmed; blank lines have no place in the sequence. A line's id is the hash
of its trimmed text. A run of lines is a later copy if the same run begins at an earlier place (smaller doc_id,
or an earlier line of the same document) and it is large enough: ``min_lines`` lines with ``min_chars`` characters
together, or (``alone``) a line of more than so many words in it, which may be all of it. All lines of all later copies are deleted, with
the blank lines between them; so what is deleted is a union of runs that each occur before, and the first copy
always stays.

Ranks come by prefix doubling: a round has, for each place whose run of h lines occurs several times, that
run's class; joining places h apart gives the classes of 2h lines, of which again those with several members
stay. Any run of ``min_chars`` lines is large enough, so places need no order beyond that depth: the rounds end
there. A run of h + r lines (r < h) is known by the classes of h lines at its begin and r places on, so the
places with the same two classes are the interval of the suffix array whose common prefix has h + r lines;
its smallest place is the first copy. Two such lengths decide a place: the smallest that is large enough (equal
runs have it in common), and, if that is a later copy, the longest common prefix with an earlier place. The
second is looked up as far as the next place does not begin a large enough run itself: beyond that the next
place's run covers the same lines.

Classes are counted with partial sums and joined back, a join that Spark divides where a class is frequent; no
class is ever gathered. Null or empty text has no lines. Rows with a null doc_id stay as they are and count
for no other row. Rows with the same doc_id and text are one document; rows with the same doc_id and other
texts follow each other by their texts' hashes. Lines are compared by 64-bit hashes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import drop, table

MIN_LINES, MIN_CHARS = 2, 20
#: Words beyond which a line is a run by itself.
PASSAGE_WORDS = 50
_KEY = ["doc_id", "tie"]
_PLACE = [*_KEY, "at"]
_BLANK = " \t\r\x0b\x0c"


def _lines(text: str) -> Column:
    return F.when(F.length(text) > 0, F.split(F.col(text), "\n", -1)).otherwise(F.array().cast("array<string>"))


def _needed(ids: Column, min_lines: int, min_chars: int, alone: int | None) -> Column:
    """For each line the number of lines of the smallest run from it that is large enough, null if the text ends before."""
    zero = F.struct(F.lit(0).alias("lines"), F.lit(0).alias("chars"), F.lit(None).cast("int").alias("need"))

    def add(so_far: Column, x: Column) -> Column:
        lines, chars = so_far["lines"] + 1, so_far["chars"] + x["size"]
        enough = (lines >= min_lines) & (chars >= min_chars)
        return F.struct(lines.alias("lines"), chars.alias("chars"), F.coalesce(so_far["need"], F.when(enough if alone is None else enough | x["long"], lines)).alias("need"))

    def need(x: Column, i: Column) -> Column:
        out = F.aggregate(F.slice(ids, i + 1, max(min_lines, min_chars)), zero, add)["need"]
        if min_lines <= 2 or alone is None:  # most places need min_lines, which takes fewer steps to see
            least = F.aggregate(F.slice(ids, i + 1, min_lines), F.lit(0), lambda a, y: a + y["size"])
            out = F.when((i + min_lines <= F.size(ids)) & (least >= min_chars), F.lit(min_lines)).otherwise(out)
        return out if alone is None else F.when(x["long"], F.lit(1)).otherwise(out)

    return F.transform(ids, need)


def line_places(docs: DataFrame, min_lines: int, min_chars: int, alone: int | None) -> DataFrame:
    """A row a line that is not blank: ``doc_id``, ``tie`` (the text's hash), ``at`` (its place), ``class``, ``need`` and ``most``.

    ``need``: lines of the smallest run from here that is large enough; ``most``: of the longest that the next
    place's own runs do not cover.
    """
    # most texts have no blanks but spaces, which are trimmed several times faster
    odd = reduce(lambda a, b: a | b, [F.contains("text", F.lit(c)) for c in _BLANK[1:]])
    trimmed = F.when(odd, F.transform(_lines("text"), lambda x: F.btrim(x, F.lit(_BLANK)))).otherwise(F.transform(_lines("text"), lambda x: F.trim(x)))
    full = F.filter(trimmed, lambda x: F.length(x) > 0)

    long = lambda x: (F.length(x) > 2 * alone) & x.rlike(f"^(?:[^{_BLANK}]++[{_BLANK}]++){{{alone}}}[^{_BLANK}]")
    ids = F.transform(full, lambda x: F.struct(F.xxhash64(x).alias("class"), F.length(x).alias("size"), *([] if alone is None else [long(x).alias("long")])))
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tie"), ids.alias("ids"))
    # after the deal by document, lines and needs are columns of their own, which no lambda computes again
    needed = rows.dropDuplicates(_KEY).withColumn("needs", _needed(F.col("ids"), min_lines, min_chars, alone))
    of = F.zip_with("ids", "needs", lambda x, n: F.struct(x["class"].alias("class"), n.alias("need")))
    after = F.concat(F.slice("needs", 2, F.size("needs")), F.array(F.lit(None).cast("int")))
    each = needed.select(*_KEY, F.size("ids").alias("lines"), F.posexplode(F.zip_with(of, after, lambda x, n: F.struct(x["class"].alias("class"), x["need"].alias("need"), n.alias("after")))).alias("at", "x"))
    most = F.coalesce("x.after", F.least(F.lit(max(min_lines, min_chars)), F.col("lines") - F.col("at")))
    return each.select(*_PLACE, "x.class", "x.need", most.alias("most"))


def _late(places: DataFrame, by: str) -> DataFrame:
    """The places that share ``by`` with others, and whether each is a ``later`` one than the first."""
    at = F.struct(*_PLACE)
    # written, so that both sides of the join are dealt out for it and Spark can divide a frequent class
    classes = table(places.groupBy(by).agg(F.min(at).alias("first"), F.count("*").alias("members")).where("members > 1").select(by, "first"), "classes")
    out = table(places.join(classes, by).withColumn("later", at > F.col("first")).drop("first"), "round")
    drop(classes)
    return out


def suffix_rounds(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS, alone: int | None = PASSAGE_WORDS) -> dict[int, DataFrame]:
    """For h = 1, 2, 4 ... the places whose run of h lines occurs several times, with its class."""
    lines = table(line_places(docs, min_lines, min_chars, alone), "lines")
    rounds = {1: _late(lines, "class")}
    drop(lines)
    h = 1
    while 2 * h <= max(min_lines, min_chars) and not rounds[h].isEmpty():
        now = rounds[h]
        after = now.select(*_KEY, (F.col("at") - h).alias("at"), F.col("class").alias("next"))
        pairs = table(now.drop("later").join(after, _PLACE).withColumn("class", F.xxhash64("class", "next")).drop("next"), "pairs")
        h *= 2
        rounds[h] = _late(pairs, "class")
        drop(pairs)
    return rounds


def _run_of(rows: DataFrame, places: DataFrame) -> DataFrame:
    """``rows`` (``h``, a place, its ``class``, ``r``) with the hash ``run`` of the h + r lines from the place, those that occur once left out."""
    far = places.select("h", *_KEY, F.col("at").alias("far"), F.col("class").alias("next"))
    return rows.withColumn("far", F.col("at") + F.col("r")).join(far, ["h", *_KEY, "far"]).withColumn("run", F.xxhash64("h", "r", "class", "next")).drop("far", "next")


def later_copies(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS, alone: int | None = PASSAGE_WORDS) -> DataFrame:
    """A row a later copy: ``doc_id``, ``tie``, ``at`` and ``lines``, as long as an earlier place has the same lines (see above)."""
    rounds = suffix_rounds(docs, min_lines, min_chars, alone)
    places = reduce(DataFrame.unionByName, [p.withColumn("h", F.lit(h)) for h, p in rounds.items()])
    need, h = F.col("need"), F.col("h")
    between = _run_of(places.where((need > h) & (need < 2 * h)).drop("later").withColumn("r", need - h), places)
    starts = table(places.where((need == h) & F.col("later")).select(*_PLACE, "need", "most").unionByName(_late(between, "run").where("later").select(*_PLACE, "need", "most")), "starts")
    lines = F.col("lines")
    power = F.greatest(*[F.when(lines >= k, F.lit(k)).otherwise(F.lit(1)) for k in rounds], F.lit(1))
    longer = starts.where("most > need").withColumn("lines", F.explode(F.sequence(F.col("need") + 1, F.col("most")))).withColumn("h", power).withColumn("r", lines - h).where("r < h")
    asked = table(_run_of(longer.select("h", *_PLACE, "lines", "r").join(places.select("h", *_PLACE, "class"), ["h", *_PLACE]), places), "asked")
    if asked.isEmpty():
        return starts.select(*_PLACE, need.alias("lines"))
    # the first place of each interval that is asked for, from all its places
    kinds = table(asked.select("h", "class", "r").distinct(), "kinds")
    members = _run_of(places.select("h", *_PLACE, "class").join(kinds, ["h", "class"]), places)
    first = table(members.groupBy("run").agg(F.min(F.struct(*_PLACE)).alias("first")), "first")
    common = asked.join(first, "run").where(F.struct(*_PLACE) > F.col("first")).groupBy(*_PLACE).agg(F.max("lines").alias("lines"))
    return starts.join(common, _PLACE, "left").select(*_PLACE, F.coalesce("lines", "need").alias("lines"))


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS, alone: int | None = PASSAGE_WORDS) -> DataFrame:
    """``doc_id``, ``tie`` and ``runs`` (structs ``a``, ``b``: places among the lines that are not blank, b exclusive) that later copies cover.

    Later copies that overlap or touch in a document are one run.
    """
    if min_lines < 1 or min_chars < 1:
        raise ValueError("a run needs a line and a character at least")
    copies = later_copies(docs, min_lines, min_chars, alone).withColumn("end", F.col("at") + F.col("lines"))
    by = Window.partitionBy(*_KEY).orderBy("at")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    parted = copies.withColumn("new", F.coalesce(F.col("at") > before, F.lit(True)).cast("int")).withColumn("part", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    merged = parted.groupBy(*_KEY, "part").agg(F.min("at").alias("a"), F.max("end").alias("b"))
    return merged.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("runs"))


def _without(lines: Column, runs: Column) -> Column:
    """The lines outside the runs (structs a, b in order, both inclusive), as slices between one run and the next."""
    before = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["b"] + 1))
    upto = F.concat(F.transform(runs, lambda r: r["a"]), F.array(F.size(lines)))
    return F.flatten(F.zip_with(before, upto, lambda x, y: F.slice(lines, x + 1, y - x)))


def line_dedup(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS, alone: int | None = PASSAGE_WORDS) -> DataFrame:
    """``row`` (a row of ``docs`` as it is), ``text`` without later copies, ``n_lines``, ``n_deleted``, ``n_runs``, ``longest_run``.

    ``n_deleted`` and ``longest_run`` (the longest of the merged runs) count lines that are not blank.
    """
    of = repeated_runs(docs, min_lines, min_chars, alone)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tie"))
    both = rows.join(of, _KEY, "left")
    some, all_ = F.col("runs").isNotNull(), F.split("row.text", "\n", -1)
    # lines that are not blank, by number; columns of their own, so that the lambdas do not split again
    numbered = F.filter(F.transform(all_, lambda x, i: F.when(F.length(F.btrim(x, F.lit(_BLANK))) > 0, i)), lambda i: i.isNotNull())
    wide = both.withColumns({"all": F.when(some, all_), "full": F.when(some, numbered)})
    spans = wide.withColumn("spans", F.when(some, F.transform("runs", lambda r: F.struct(F.get("full", r["a"]).alias("a"), F.get("full", r["b"] - 1).alias("b")))))
    text = F.when(some, F.array_join(_without(F.col("all"), F.col("spans")), "\n")).otherwise(F.col("row.text"))
    sizes = F.transform("runs", lambda r: r["b"] - r["a"])
    none = lambda c: F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint"))
    n_lines = F.when(F.length("row.text") > 0, F.length("row.text") - F.length(F.translate("row.text", "\n", "")) + 1).otherwise(0).cast("bigint")
    return spans.select("row", text.alias("text"), n_lines.alias("n_lines"), none(F.aggregate(sizes, F.lit(0), lambda a, x: a + x)).alias("n_deleted"), none(F.when(some, F.size("runs"))).alias("n_runs"), none(F.array_max(sizes)).alias("longest_run"))


def line_digest(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS, alone: int | None = PASSAGE_WORDS) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_deleted``, ``n_runs``, ``longest_run`` and ``kept_sha256`` of each row of ``docs(doc_id, text)``."""
    out = line_dedup(docs.select("doc_id", "text"), min_lines, min_chars, alone)
    return out.select("row.doc_id", "n_lines", "n_deleted", "n_runs", "longest_run", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def without_copies(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS, alone: int | None = PASSAGE_WORDS) -> DataFrame:
    """The rows and columns of ``docs``, ``text`` without later copies and ``n_chars`` (if there) its length."""
    out = line_dedup(docs, min_lines, min_chars, alone)
    columns = []
    for c, kind in docs.dtypes:
        new = F.col("text") if c == "text" else F.length("text").cast(kind) if c == "n_chars" else F.col(f"row.`{c}`")
        columns.append(new.alias(c))
    return out.select(*columns)
