"""Near-duplicate lines by segment-partition edit join (Pass-Join), and documents without their later copies.

A line is cut into threshold + 1 segments. Two lines within the threshold share at least one segment, at a place that
the lengths and the threshold bound, so an equi-join of segments with length-aware substrings finds every pair. Exact
copies are folded into one line first. Three steps follow:

1. Each key meets one line that has it as a segment. Lines that share no key with another line are done; only key and
   id are shuffled for this, and text is fetched for the few lines that are left, by a join of co-located buckets.
2. Each key's lines are compared with one of them only, and verified; links are contracted to components. While that
   links many lines, it is done again with another line for each key. A large group of near copies so costs a few
   comparisons for each member and key, not one for each pair.
3. Lines that share a key and are in different components yet are compared with each other.

Pairs must agree on letter counts as far as the threshold allows; a banded bit-parallel automaton over the diagonals
decides on the whole lines. Everything is a DataFrame operation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE_CHARS, Scratch, connected_components, let

#: Letters whose counts, modulo 8, are compared before a pair is verified: frequent ones, as other words change them.
SKETCH = "etaoinshrdlucmf"
#: Shortest lines, in characters for each edit of the threshold, that may be near copies; shorter ones are equal or not.
LEAST_FOR_EDIT = 10
#: Rounds with one representative for each key, at most, and the part of the lines that one must link for another.
ROUNDS, WORTH = 3, 0.1


#: Segments of the filter before the automaton.
PIECES = 12


def segments(rest: int, parts: int) -> list[tuple[int, int, int]]:
    """(segment, start, length) of the segments of a line of n characters; starts and lengths are without multiples of n // parts.

    ``rest`` is what n leaves over the number of segments.
    """
    return [(i, rest * i // parts, rest * (i + 1) // parts - rest * i // parts) for i in range(parts)]


def windows(rest: int, tau: int) -> list[tuple[int, int, int]]:
    """Like segments, for the substrings that may equal a segment of a line that is shorter by 0 .. tau.

    Multi-match-aware: for segment i (from 0) and a length shorter by d, the start may move by i to the left at most
    and by the edits that then remain to the right, seen from either end of the line. Lengths that cut the same
    substring share it.
    """
    parts, out = tau + 1, set()
    for d in range(tau + 1):
        for i, at, size in segments(rest - d, parts):
            out |= {(i, at + move, size) for move in range(max(-i, d - (tau - i)), min(i, d + (tau - i)) + 1)}
    return sorted(out)


def keyed(lines: DataFrame, tau: int, probe: bool) -> DataFrame:
    """``lines(line, n, ...)`` with a row for each segment, or each substring that probes, and its key; without line."""
    parts = tau + 1
    row = lambda w: F.struct(*(F.lit(x).alias(c) for c, x in zip(("i", "at", "size"), w, strict=True)))
    cuts = [F.array(*map(row, windows(r, tau) if probe else segments(r, parts))) for r in range(parts)]
    chosen = cuts[tau]
    for r in range(tau):
        chosen = F.when(F.col("n") % parts == r, cuts[r]).otherwise(chosen)
    k = F.call_function("div", F.col("n"), F.lit(parts)).cast("int")
    # One small expression for each row of an explode is compiled; an array of all of them would be too large for that
    cut = lines.withColumn("_w", F.explode(chosen)).withColumn("_at", k * F.col("_w.i") + F.col("_w.at")).withColumn("_size", k + F.col("_w.size"))
    cut = cut.where((F.col("_at") >= 0) & (F.col("_size") >= 1) & (F.col("_at") + F.col("_size") <= F.col("n")))
    return cut.withColumn("key", F.xxhash64("_w.i", F.substring("line", F.col("_at") + 1, F.col("_size")))).drop("_w", "_at", "_size", "line")


def enough_pieces(a: Column, b: Column, tau: int) -> Column:
    """False only if more pieces of b than tau edits can touch are nowhere near their place in a."""
    n, found = F.length(b), F.lit(0)
    for i in range(PIECES):
        at, end = _cut(n, i), _cut(n, i + 1)
        begin = F.greatest(at - tau, F.lit(0))
        found = found + F.contains(F.substring(a, begin + 1, end + tau - begin), F.substring(b, at + 1, end - at)).cast("int")
    return found >= PIECES - tau


def _cut(n: Column, i: int) -> Column:
    return F.call_function("div", n * i, F.lit(PIECES)).cast("int")


def middles(a: Column, b: Column) -> tuple[Column, Column]:
    """Two strings without pieces that both begin or end with, which leaves the edit distance as it is."""
    m, n = F.length(a), F.length(b)
    least = F.least(m, n)
    cuts = [_cut(least, i) for i in range(1, PIECES)]
    head = F.greatest(F.lit(0), *[F.when(F.left(a, c) == F.left(b, c), c) for c in cuts])
    tail = F.least(F.greatest(F.lit(0), *[F.when(F.right(a, c) == F.right(b, c), c) for c in cuts]), least - head)
    return F.substring(a, head + 1, m - head - tail), F.substring(b, head + 1, n - head - tail)


def sketch(line: Column) -> Column:
    """The counts of fifteen letters modulo 8, four bits each."""
    n = F.length(line)
    out = F.lit(0).cast("long")
    for k, c in enumerate(SKETCH):
        out = out.bitwiseOR(F.shiftleft(((n - F.length(F.replace(line, F.lit(c), F.lit("")))) % 8).cast("long"), 4 * k))
    return out


def sketches_agree(a: Column, b: Column, tau: int) -> Column:
    """False only if the letter counts rule out tau edits: an edit changes two counts by one at most.

    All counts are compared at once, each in its four bits, so that a join's condition stays small enough to be compiled.
    """
    lanes = lambda x: F.lit(sum(x << 4 * k for k in range(len(SKETCH)))).cast("long")
    less = (a.bitwiseOR(lanes(8)) - b).bitwiseAND(lanes(7))
    # A difference of four or more is the shorter way round
    over = F.shiftrightunsigned(less, 2).bitwiseAND(lanes(1))
    over = F.shiftleft(over, 3) - over
    apart = less.bitwiseAND(lanes(7).bitwiseXOR(over)).bitwiseOR((lanes(8) - less).bitwiseAND(over))
    bytes_ = F.lit(sum(15 << 8 * k for k in range(8))).cast("long")
    total = apart.bitwiseAND(bytes_) + F.shiftrightunsigned(apart, 4).bitwiseAND(bytes_)
    for shift in (32, 16, 8):
        total = total + F.shiftrightunsigned(total, shift)
    return total.bitwiseAND(F.lit(255)) <= 2 * tau


def within(a: Column, b: Column, tau: int) -> Column:
    """Whether the edit distance of two columns of strings is tau at most; the columns must be plain references.

    State e of the automaton is a word of 2 * tau + 1 bits, one for each diagonal of the band: the cells of the current
    row that e edits reach. A character of ``a`` moves all diagonals at once; all words share one long.
    """
    width = 2 * tau + 1
    full = (1 << width) - 1
    start = sum((((1 << (e + 1)) - 1) << tau) << (width * e) for e in range(tau + 1))
    part = lambda x, e: F.shiftrightunsigned(x, width * e).bitwiseAND(F.lit(full).cast("long"))

    def step(acc: Column, x: Column) -> Column:
        match = F.lit(0).cast("long")
        for d in range(width):
            match = match.bitwiseOR(F.when(x["c"].eqNullSafe(F.get(b, x["i"] + (d - tau))), F.lit(1 << d).cast("long")).otherwise(F.lit(0).cast("long")))
        out, before = [], None
        for e in range(tau + 1):
            row = part(acc, e).bitwiseAND(match)
            if e:
                row = row.bitwiseOR(part(acc, e - 1)).bitwiseOR(F.shiftrightunsigned(part(acc, e - 1), 1)).bitwiseOR(F.shiftleft(before, 1).bitwiseAND(F.lit(full).cast("long")))
            out.append(row)
            before = row
        total = out[0]
        for e, row in enumerate(out[1:], 1):
            total = total.bitwiseOR(F.shiftleft(row, width * e))
        return total

    chars = F.transform(a, lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    ends = F.aggregate(chars, F.lit(start).cast("long"), step)
    at = F.size(b) - F.size(a) + tau
    last = F.get(F.array(*[F.lit(1 << d).cast("long") for d in range(width)]), at)
    return (F.abs(F.size(a) - F.size(b)) <= tau) & (part(ends, tau).bitwiseAND(last) != 0)


def candidates(lines: DataFrame, tau: int) -> DataFrame:
    """(id): the lines of ``lines(id, line)`` that share a key with another one."""
    sized = lines.select("id", "line", F.length("line").alias("n"))
    # One line stands for each key, so that a key of very many lines is a row on this side
    held = keyed(sized, tau, False).groupBy("key").agg(F.min("id").alias("head"))
    met = keyed(sized, tau, True).select("id", "key").join(held.hint("shuffle_hash"), "key").where("id != head")
    return met.select(F.explode(F.array("id", "head")).alias("id")).distinct()


def verified(pairs: DataFrame, lines: DataFrame, scratch: Scratch, tag: str, tau: int) -> DataFrame:
    """The rows of ``pairs(a, b)`` whose lines, of ``lines(id, line)``, are within tau edits."""
    chars = lambda c: F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))
    with_a = pairs.join(lines.select(F.col("id").alias("a"), F.col("line").alias("la")), "a")
    both = with_a.join(lines.select(F.col("id").alias("b"), F.col("line").alias("lb")), "b")
    left, right = middles(F.col("la"), F.col("lb"))
    both = both.where(enough_pieces(F.col("la"), F.col("lb"), tau)).select("a", "b", left.alias("la"), right.alias("lb"))
    cut = scratch.save(both.select("a", "b", chars(F.col("la")).alias("ca"), chars(F.col("lb")).alias("cb")), f"cut{tag}")
    out = scratch.save(cut.where(within(F.col("ca"), F.col("cb"), tau)).select("a", "b"), f"links{tag}")
    scratch.drop(f"cut{tag}")
    return out


def edit_components(lines: DataFrame, scratch: Scratch, tau: int = 2) -> DataFrame:
    """(node, component) of the lines of ``lines(id, line)``, ids distinct and not null, that an edit distance of tau or less links.

    Exact for lines of more than tau characters; shorter ones are left out. Lines without a link have no row.
    """
    some = lines.withColumn("n", F.length("line")).where(F.col("n") > tau).withColumn("sketch", sketch(F.col("line")))
    own = scratch.save(keyed(some, tau, False), "own")
    probe = scratch.save(keyed(some, tau, True), "probe")
    size = lines.count()

    def near(less: Column) -> Column:
        return (F.abs(less) <= tau) & (F.col("x.component") != F.col("y.component")) & sketches_agree(F.col("x.sketch"), F.col("y.sketch"), tau)

    less = F.col("x.n") - F.col("y.n")
    links, parts = None, None

    def labelled(df: DataFrame) -> DataFrame:
        if parts is None:
            return df.withColumn("component", F.col("id"))
        return df.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))

    for k in range(ROUNDS):
        member = F.struct(F.xxhash64("id", F.lit(k)).alias("turn"), "id", "n", "sketch", "component")
        heads = labelled(own).groupBy("key").agg(F.min(member).alias("y")).select("key", "y.*").alias("y")
        met = labelled(probe).alias("x").join(heads, F.col("x.key") == F.col("y.key"))
        met = met.where(near(less)).select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b"))
        new = verified(met.distinct(), lines, scratch, str(k), tau)
        more = new.count()
        links = new if links is None else links.union(new)
        if more:
            parts = scratch.save(connected_components(links, scratch, f"round{k}-"), f"parts{k}")
        if more <= WORTH * size:
            break
    x, y = labelled(probe).alias("x"), labelled(own).alias("y")
    # The longer line probes; of two lines of one length the one with the larger id
    first = (less > 0) | (less == 0) & (F.col("x.id") > F.col("y.id"))
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & first & near(less)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    new = verified(rest.distinct(), lines, scratch, "-rest", tau)
    if parts is None or new.count():
        parts = scratch.save(connected_components(links.union(new), scratch, "all-"), "parts-all")
    for tag in ("own", "probe"):
        scratch.drop(tag)
    return parts


def document_key() -> Column:
    """A document's number: a hash of its id and its text, the same however rows are dealt out."""
    return F.xxhash64("doc_id", "text", F.lit(7))


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE_CHARS))


def _lines(docs: DataFrame) -> DataFrame:
    """The lines that hold anything, without white space at the ends."""
    cut = docs.select("doc_id", document_key().alias("key"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    cut = cut.withColumn("line", _trimmed(F.col("line"))).where(F.col("line") != "")
    # One hash alone could take two of very many lines for one; two of them don't
    return cut.withColumn("id", F.xxhash64("line")).withColumn("id2", F.xxhash64(F.lit(1), "line"))


def line_classes(docs: DataFrame, scratch: Scratch, tau: int) -> DataFrame:
    """(id, id2, class, first): each distinct line that occurs twice or is linked, its class and the place (doc_id, key, pos) of its first line."""
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "pos")
    folded = _lines(docs).groupBy("id", "id2").agg(F.min(place).alias("first"), F.max("line").alias("line"), F.count("*").alias("times"))
    # The buckets are those of the fold's own shuffle: texts move once
    distinct = scratch.save_by(folded, "distinct", "id", "id2")
    long = distinct.where(F.length("line") >= LEAST_FOR_EDIT * tau)
    ids = scratch.save(candidates(long.select("id", "line"), tau), "ids")
    both = distinct.select("id", "id2").join(ids, "id")
    some = scratch.save(long.select("id", "id2", "line").join(both.hint("shuffle_hash"), ["id", "id2"], "left_semi").select("id", "line"), "some")
    parts = edit_components(some, scratch, tau)
    named = distinct.select("id", "id2", "first", "times").join(parts.withColumnRenamed("node", "id"), "id", "left")
    named = named.where("times > 1 or component is not null").withColumn("class", F.coalesce("component", "id"))
    named = scratch.save(named.drop("times"), "named")
    # Only lines with a partner need another's first place
    firsts = named.where("component is not null").groupBy("component").agg(F.min("first").alias("class_first"))
    linked = named.join(firsts, "component").select("id", "id2", "class", F.col("class_first").alias("first"))
    out = linked.union(named.where("component is null").select("id", "id2", "class", "first"))
    out = scratch.save(out, "classes")
    for tag in ("distinct", "some", "ids", "named"):
        scratch.drop(tag)
    return out


def mark_lines(docs: DataFrame, tau: int = 2) -> DataFrame:
    """``docs(doc_id, text, ...)`` with _qw_lines (array of pos, class, kept, first_id by pos), _qw_hashes and _qw_n_lines.

    _qw_lines has the lines that have a copy or a near copy anywhere; a line's class by itself is its hash in
    _qw_hashes (null for blank lines). A line is kept if no line of its class comes earlier, by doc_id and then by
    place. Lines of LEAST_FOR_EDIT * tau characters or more are in a class with all that tau edits reach, shorter ones
    with their exact copies. Rows that repeat an id and its text are one document and are marked alike; of a text under
    several ids, the first id keeps the lines. Null texts have no lines; null ids come last, by a hash of the text.
    Empty input: empty result. All columns of ``docs`` are carried along; names that begin with _qw_ are reserved.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    slim = docs.select("doc_id", "text")
    classes = line_classes(slim, scratch, tau)
    placed = _lines(slim).select("key", "pos", "id", "id2").join(classes.hint("shuffle_hash"), ["id", "id2"])
    kept = (F.col("key") == F.col("first.key")) & (F.col("pos") == F.col("first.pos"))
    per = placed.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("pos", "class", kept.alias("kept"), F.col("first.doc_id").alias("first_id")))).alias("_qw_lines"))
    per = scratch.save(per.withColumnRenamed("key", "_qw_key"), "documents")
    n = F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    hashes = F.transform(F.transform(F.split("text", "\n"), _trimmed), lambda x: F.when(x != "", F.xxhash64(x)))
    # What is worked out of a text is so below the join, which then moves it in the text's place
    keyed = docs.withColumn("_qw_key", document_key()).withColumn("_qw_n_lines", n).withColumn("_qw_hashes", hashes)
    return keyed.join(per, "_qw_key", "left")


def classes_of_lines() -> Column:
    """The classes of a marked document's lines that hold anything, by place."""
    row = lambda pos, of: F.struct(pos.alias("pos"), of.alias("class"))
    none = F.array().cast("array<int>")
    listed = F.coalesce(F.transform("_qw_lines", lambda x: row(x["pos"], x["class"])), F.array().cast("array<struct<pos:int,class:bigint>>"))
    filled = F.filter(F.transform("_qw_hashes", lambda h, i: F.when(h.isNotNull(), i)), lambda i: i.isNotNull())
    others = F.array_except(F.coalesce(filled, none), F.coalesce(F.transform("_qw_lines", lambda x: x["pos"]), none))
    alone = F.transform(others, lambda i: row(i, F.get("_qw_hashes", i)))
    return F.transform(F.array_sort(F.concat(listed, alone)), lambda x: x["class"])


def removed() -> Column:
    """The places of the lines of a marked document that go."""
    return F.coalesce(F.transform(F.filter("_qw_lines", lambda x: ~x["kept"]), lambda x: x["pos"]), F.array().cast("array<int>"))


def clean_text() -> Column:
    """The text of a marked document without the lines that go; null stays null."""
    def rest(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed())
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    return F.when(F.size(removed()) == 0, F.col("text")).otherwise(let(F.split("text", "\n"), rest))


def dedup_lines(docs: DataFrame, tau: int = 2) -> DataFrame:
    """``docs`` with cleaned texts, without the documents of which nothing but white space is left. See mark_lines."""
    marked = mark_lines(docs, tau).withColumn("_qw_clean", clean_text()).withColumn("_qw_some", F.size(removed()) > 0)
    left = marked.where(~F.col("_qw_some") | (_trimmed(F.col("_qw_clean")) != ""))
    return left.withColumn("text", F.col("_qw_clean")).select(*docs.columns)
