"""Near-duplicate lines by a segment-partition edit join, in DataFrame functions only.

A line of length l is cut into threshold + 1 segments of nearly equal length.
Two lines within `threshold` edits share one segment at least, and at a place
that the edits before and after it bound; so a line probes, for each length
that a partner may have, only those of its substrings that a segment could
match.  What meets is verified by the edit distance, computed in a band of
2 * threshold + 1 diagonals with one word of bits a column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probeline.llm.common import bucketed, release, spill

#: Lines within so many edits (of characters) are near.
THRESHOLD = 2
#: A segment that more lines have is joined under a closer condition.
HOT = 16
#: The lines of a segment that more lines have meet by the rest of the line, cut into segments again.
CROWDED = 1024
#: Shorter lines are near to no other.
MIN_CHARS = 10 * THRESHOLD
#: The queries take out exact copies of lines of so many characters at least, except blank ones.
COPY_CHARS = 1
#: Lines of fewer words aren't near for a replaced word.
MIN_WORDS = 8
#: The queries let one word be replaced, and one more for each so many words of the line from the second such stretch on.
WORDS_PER_EDIT = 32


def segment(length: Column, threshold: int, i: Column) -> tuple[Column, Column]:
    """(start from 0, length) of segment i of a line; the last ones are longer by one where it doesn't divide."""
    parts = threshold + 1
    longer = F.pmod(length, F.lit(parts)).cast("int")
    short = F.call_function("div", length - longer, F.lit(parts)).cast("int")
    before = F.greatest(F.lit(0), i - (F.lit(parts) - longer))
    return i * short + before, short + (i >= F.lit(parts) - longer).cast("int")


def segments(length: Column, threshold: int) -> list[tuple[Column, Column]]:
    """(start from 0, length) of each segment of a line."""
    return [segment(length, threshold, F.lit(i)) for i in range(threshold + 1)]


def _wide(line: Column) -> Column:
    """The line with 4 bytes for each character, so that a substring is found without counting."""
    return F.encode(F.make_valid_utf8(line), "UTF-32")


def _key(wide: Column, length: Column, i: Column, start: Column, size: Column) -> Column:
    return F.xxhash64(length, i, F.substring(wide, 4 * start + 1, 4 * size))


def _index_keys(wide: Column, length: Column, threshold: int) -> list[Column]:
    return [_key(wide, length, F.lit(i), start, size) for i, (start, size) in enumerate(segments(length, threshold))]


def _probes(threshold: int) -> Column:
    """(less, i, move) of each substring that may be a segment of a line as long or up to `threshold` shorter.

    With segment i (from 0) matched, at most i edits lie before it if it is
    the first that matches and at most threshold - i after it if it is the
    last; a start beyond either bound would match a segment elsewhere too.
    """
    out = []
    for less in range(threshold + 1):
        for i in range(threshold + 1):
            lo, hi = max(-i, less - (threshold - i)), min(i, less + threshold - i)
            out += [F.struct(F.lit(less).alias("less"), F.lit(i).alias("i"), F.lit(move).alias("move")) for move in range(lo, hi + 1)]
    return F.array(*out)


def _probe_key(wide: Column, length: Column, threshold: int, probe: str) -> Column:
    """The key of one of the probes.

    All keys in one expression would be a method too long for the JVM's
    compiler (over 8,000 bytes), so a row a probe comes first.
    """
    less, i, move = (F.col(f"{probe}.{x}") for x in ("less", "i", "move"))
    start, size = segment(length - less, threshold, i)
    return _key(wide, length - less, i, start + move, size)


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def within(a: Column, b: Column, threshold: int) -> Column:
    """Whether the texts a and b are within `threshold` edits.

    What both begin with is cut off; the rest runs through the bit-parallel
    recurrence over the band of diagonals, until the distance is too far.  Bit k of a word stands
    for row j - threshold + k of column j; a bit of d0 says that the cell equals
    its upper left neighbour, so the distance is the sum of the unset bits on the
    diagonal that ends in the last cell.
    """
    t, top = threshold, (1 << (2 * threshold + 1)) - 1

    def common(x: Column, y: Column) -> Column:
        same = F.zip_with(x, y, lambda p, q: p.eqNullSafe(q))
        at = F.array_position(F.concat(same, F.array(F.lit(False))), F.lit(False))
        return F.least(at - 1, F.size(x), F.size(y)).cast("int")

    def chars(text: Column) -> Column:
        return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))

    def band(x: Column, y: Column) -> Column:
        m, n = F.size(x), F.size(y)

        def column(state: Column, j: Column) -> Column:
            match = F.lit(0)
            for k in range(2 * t + 1):
                hit = F.get(x, j - F.lit(1 + t - k)) == F.get(y, j - 1)
                match = match.bitwiseOR(F.when(hit, F.lit(1 << k)).otherwise(F.lit(0)))
            vp, vn = state["vp"], state["vn"]

            def after(s: Column) -> Column:
                d0, up, down = s["d0"], s["up"], s["down"]
                moved = F.shiftright(d0, 1)
                bit = F.call_function("shiftright", d0, m - n + F.lit(t)).bitwiseAND(F.lit(1))
                return F.struct(
                    down.bitwiseOR(F.bitwise_not(moved.bitwiseOR(up))).bitwiseAND(F.lit(top)).alias("vp"),
                    moved.bitwiseAND(up).alias("vn"),
                    (state["far"] + F.when(j + m - n >= 1, F.lit(1) - bit).otherwise(F.lit(0))).alias("far"),
                )

            def sides(d0: Column) -> Column:
                up = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))).bitwiseAND(F.lit(top))
                return _let(F.struct(d0.alias("d0"), up.alias("up"), d0.bitwiseAND(vp).alias("down")), after)

            def diagonal(p: Column) -> Column:
                return _let((p.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(p).bitwiseOR(vn).bitwiseAND(F.lit(top)), sides)

            return _let(match, diagonal)

        def unless_far(state: Column, j: Column) -> Column:
            return F.when(state["far"] > t, state).otherwise(column(state, j))

        begin = F.struct(F.lit(top & ~((1 << t) - 1)).alias("vp"), F.lit(0).alias("vn"), F.abs(m - n).alias("far"))
        columns = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        return F.when(F.abs(m - n) > t, F.lit(False)).otherwise(F.aggregate(columns, begin, unless_far, lambda s: s["far"] <= t))

    def trimmed(s: Column) -> Column:
        x, y = s["x"], s["y"]
        return _let(common(x, y), lambda n: _let(
            F.struct(F.slice(x, n + 1, F.size(x)).alias("x"), F.slice(y, n + 1, F.size(y)).alias("y")), lambda z: band(z["x"], z["y"])))

    return _let(F.struct(chars(a).alias("x"), chars(b).alias("y")), trimmed)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _order(id_: Column) -> Column:
    """A null id is before all others."""
    return F.coalesce(id_.cast("long"), F.lit(-(2**63)).cast("long"))


def _taken(line: Column, min_chars: int, copy_chars: int) -> Column:
    """Whether a line may be taken out: shorter ones than min_chars, as copies only, if they aren't blank."""
    long = F.char_length(line) >= min_chars
    if copy_chars >= min_chars:
        return long
    return long | ((F.char_length(line) >= copy_chars) & line.rlike(r"(?U)\S"))


def distinct_lines(docs: DataFrame, min_chars: int, copy_chars: int, id_col: str, text_col: str) -> tuple[DataFrame, Callable[[], None]]:
    """(id, line, length, first) of each different line that may be taken out; first is the (doc, text, no) where it occurs first.

    text is a hash of the whole text, which parts rows of one id.  Also what
    deletes the table.
    """
    lines = docs.select(_order(F.col(id_col)).alias("doc"), F.xxhash64(text_col).alias("text"), F.posexplode(_lines(F.col(text_col))).alias("no", "line"))
    lines = lines.where(_taken(F.col("line"), min_chars, copy_chars)).withColumn("id", F.xxhash64("line"))
    once = lines.groupBy("id").agg(F.any_value("line").alias("line"), F.min(F.struct("doc", "text", "no")).alias("first"))
    return bucketed(once.withColumn("length", F.char_length("line")), "lines", "id")


def _parities(line: Column) -> Column:
    """Two words of bits: whether each class of characters, and of pairs of neighbours, occurs an odd number of times."""

    def word(parts: Column) -> Column:
        return F.aggregate(parts, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))))

    chars = F.split(line, "")
    pairs = F.zip_with(chars, F.slice(chars, 2, F.size(chars)), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.struct(word(chars).alias("ones"), word(pairs).alias("twos"))


def near_lines(lines: DataFrame, threshold: int, hot: int = HOT, crowded: int = CROWDED) -> DataFrame:
    """(id): the lines within `threshold` edits of one that occurs before.

    A segment that more than `hot` lines have would give the square of their
    number in pairs.  Its lines meet in a second join, whose condition lets only
    those pairs out that `threshold` edits can explain: an edit changes two
    characters' parities at most, and four pairs'.  A segment that more than
    `crowded` lines have is only the beginning of a key: see crowded_lines.
    """
    wide, length = F.col("wide"), F.col("length")
    keyed = lines.select("id", "length", _wide(F.col("line")).alias("wide"))
    index = keyed.select(F.col("id").alias("a"), "length", F.posexplode(F.array(*_index_keys(wide, length, threshold))).alias("part", "key"))
    probe = keyed.select("id", "length", "wide", F.explode(_probes(threshold)).alias("probe")).select(F.col("id").alias("b"), _probe_key(wide, length, threshold, "probe").alias("key"))
    by_key = Window.partitionBy("key")
    counted = index.withColumn("n", F.count("*").over(by_key)).withColumn("one", F.min("a").over(by_key))
    # a key has `hot` rows at most here, so the hash tables are even
    thin = counted.where((F.col("n") <= hot) | (F.col("a") == F.col("one"))).select(
        "key", "a", F.when(F.col("n") > hot, F.struct("key", "length", "part", (F.col("n") > crowded).alias("crowded"))).alias("hot")
    )
    different = F.col("a") != F.col("b")
    met = spill(probe.join(thin.hint("shuffle_hash"), "key").where(F.col("hot").isNotNull() | different).select("a", "b", "hot"), "met-lines")

    # every line probes its own segments too, so the probes of a hot key hold its lines
    hot_rows = met.where(F.col("hot").isNotNull()).select("hot.*", F.col("b").alias("id")).distinct()
    # the parities of these lines alone: they cost more than the keys of all
    hot_lines = spill(hot_rows.select("id").distinct().join(lines.select("id", "line", "first", F.col("length").alias("own_length")), "id"), "hot-lines")
    signed = spill(hot_rows.join(hot_lines.withColumn("sign", _parities(F.col("line"))), "id"), "hot-signs")
    apart = lambda side: F.bit_count(F.col(f"p.sign.{side}").bitwiseXOR(F.col(f"q.sign.{side}")))
    like = (apart("ones") <= 2 * threshold) & (apart("twos") <= 4 * threshold)
    few = signed.where(~F.col("crowded")).select("key", "id", "sign")
    hot_pairs = few.alias("p").join(few.alias("q"), (F.col("p.key") == F.col("q.key")) & (F.col("p.id") < F.col("q.id")) & like).select(F.col("p.id").alias("a"), F.col("q.id").alias("b"))

    # lines of one length meet both ways
    pairs = met.where(F.col("hot").isNull()).select("a", "b").unionByName(hot_pairs).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    one = lines.select(F.col("id").alias("a"), F.col("line").alias("line_a"), F.col("first").alias("first_a"))
    two = lines.select(F.col("id").alias("b"), F.col("line").alias("line_b"), F.col("first").alias("first_b"))
    near = pairs.join(one, "a").join(two, "b").where(within(F.col("line_a"), F.col("line_b"), threshold))
    later = near.select(F.when(F.col("first_a") > F.col("first_b"), F.col("a")).otherwise(F.col("b")).alias("id"))
    if not signed.where("crowded").isEmpty():
        later = later.unionByName(crowded_lines(signed.where("crowded"), like, threshold))
    later = spill(later, "near-lines")
    release(met, hot_lines, signed)
    return later


def crowded_lines(rows: DataFrame, like: Column, threshold: int) -> DataFrame:
    """(id): of lines that share a segment, those within `threshold` edits of one that occurs before.

    rows: key, length and part of the segment (length is that of the lines it
    is cut from), id, line, own_length, first, sign.  Where the segment isn't
    edited, all edits are in the rest; cut into one piece more than there may
    be edits, the rest has a piece that the other line has too, moved by
    `threshold` at most.  A piece on both sides of the segment is taken with it.
    So lines meet by segment and piece, each only until one before it is found.
    """
    line, length = F.col("line"), F.col("length")
    starts, sizes = zip(*segments(length, threshold), strict=True)
    placed = rows.withColumn("start", F.get(F.array(*starts), F.col("part"))).withColumn("size", F.get(F.array(*sizes), F.col("part")))
    start, size = F.col("start"), F.col("size")
    own = (F.col("own_length") == length) & (_key(_wide(line), length, F.col("part"), start, size) == F.col("key"))
    placed = placed.withColumn("own", own).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(threshold))))

    def end(j: Column) -> Column:
        """Where the first j of all pieces of the rest end."""
        return F.call_function("div", j * (length - size), F.lit(threshold + 1)).cast("int")

    placed = placed.withColumn("a", end(F.col("i"))).withColumn("b", end(F.col("i") + 1))
    placed = placed.withColumn("a", F.when(F.col("a") < start, F.col("a")).otherwise(F.col("a") + size)).withColumn("b", F.when(F.col("b") <= start, F.col("b")).otherwise(F.col("b") + size))
    placed = placed.withColumn("move", F.explode(F.sequence(F.lit(-threshold), F.lit(threshold))))
    piece = F.xxhash64("key", "i", F.substring(line, F.col("a") + F.col("move") + 1, F.col("b") - F.col("a")))
    met = placed.select("id", "line", "first", "sign", piece.alias("piece"), (F.col("own") & (F.col("move") == 0)).alias("cut"))
    before = (F.col("p.piece") == F.col("q.piece")) & (F.col("p.cut") | F.col("q.cut")) & (F.col("q.first") < F.col("p.first")) & like & within(F.col("p.line"), F.col("q.line"), threshold)
    return met.alias("p").join(met.alias("q"), before, "left_semi").select("id").distinct()


def replaced_lines(lines: DataFrame, per_edit: int) -> DataFrame:
    """(id): the lines of which a share of the words at most is replaced in a line that occurs before.

    Words are what single spaces part; a line of n has n / per_edit replaced, one
    at least.  Cut into one part more than that, two such lines have a part in
    common at the same place.  Only lines that share a part are compared, first
    by signs (parities of classes of words with their places, two of which a
    replaced word changes), and each only until one is found.
    """
    line = F.col("line")
    # counted without a split, which would be made once more for the filter
    n = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1

    def sized(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("n", n)
        return rows.where(F.col("n") >= MIN_WORDS).withColumn("words", F.split("line", " ")).withColumn("edits", F.greatest(F.lit(1), F.call_function("div", F.col("n"), F.lit(per_edit))).cast("int"))

    def key(i: Column) -> Column:
        start, end = (F.call_function("div", (i + F.lit(k)) * F.col("n"), F.col("edits") + 1).cast("int") for k in (0, 1))
        return F.xxhash64(F.col("n"), i, F.slice("words", start + 1, end - start))

    keys = sized(lines.select("id", "line")).select("id", F.explode(F.transform(F.sequence(F.lit(0), F.col("edits")), key)).alias("key"))
    shared = spill(keys.withColumn("lines", F.count("*").over(Window.partitionBy("key"))).where("lines > 1").select("key", "id"), "met-words")

    def flip(s: Column, x: Column) -> Column:
        return s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x, F.lit(64)).cast("int")))

    sign = F.aggregate(F.transform("words", lambda w, i: F.xxhash64(i, w)), F.lit(0).cast("long"), flip)
    # only the lines that share a part are split again
    met = sized(shared.join(lines.select("id", "first", "line"), "id")).select("key", "id", "first", "words", "n", "edits", sign.alias("sign"))
    met = spill(met, "word-signs")
    apart = F.bit_count(F.col("p.sign").bitwiseXOR(F.col("q.sign")))
    replaced = F.size(F.filter(F.zip_with("p.words", "q.words", lambda x, y: x != y), lambda d: d))
    like = (F.col("p.key") == F.col("q.key")) & (F.col("p.n") == F.col("q.n")) & (F.col("p.first") > F.col("q.first")) & (apart <= 2 * F.col("p.edits")) & (replaced <= F.col("p.edits"))
    return met.alias("p").join(met.alias("q"), like, "left_semi").select("id").distinct()


def dedup_lines(
    docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, copy_chars: int | None = None, words_per_edit: int | None = None,
    crowded: int = CROWDED,
) -> DataFrame:
    """Takes out each line that occurs before, or that is within `threshold` edits of one that does.

    Lines are what `\\n` parts.  Before: in a smaller id, or higher up in the
    same text; all is judged on the input, not on what is left.  Lines under
    min_chars characters are near to none; of those under copy_chars (without
    it, under min_chars) and of short blank ones even exact copies stay.  With
    words_per_edit, lines of MIN_WORDS words that differ in so few replaced ones
    (see replaced_lines) are near too, however many characters that is.  Adds to the columns of docs: n_lines,
    n_removed, n_near (removed though they occur here first, for a near one)
    and replaces the text by what stays, joined by `\\n`.

    A null text has no lines to take out and stays null; an empty one stays
    empty; a null id is before all others.  Rows equal in id and text are one
    document, whose lines stay in each of them; rows of one id and different
    texts are in the order of a hash of the text.  Lines are told apart by a
    64-bit hash.  Extra columns are kept, those named like the new ones
    replaced; an empty table gives no rows.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed", "n_near")]
    copy_chars = min_chars if copy_chars is None else min(copy_chars, min_chars)
    lines, drop = distinct_lines(docs, min_chars, copy_chars, id_col, text_col)
    long = lines.where(F.col("length") >= min_chars)
    later = near_lines(long, threshold, hot, crowded)
    if words_per_edit is not None:
        later = later.unionByName(replaced_lines(long, words_per_edit))
    later = later.distinct()
    marked = lines.select("id", "first").join(later.withColumn("near", F.lit(True)), "id", "left")
    # where lines are first, 63 line numbers in a word of bits
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("first.no"), F.lit(63)))
    words = marked.groupBy(F.col("first.doc").alias("_doc"), F.col("first.text").alias("_text"), F.floor(F.col("first.no") / 63).cast("int").alias("at")).agg(
        F.bit_or(F.when(F.col("near").isNull(), bit).otherwise(F.lit(0).cast("long"))).alias("stay"), F.bit_or(F.when(F.col("near"), bit).otherwise(F.lit(0).cast("long"))).alias("near")
    )
    firsts = spill(words.groupBy("_doc", "_text").agg(F.map_from_entries(F.collect_list(F.struct("at", F.struct("stay", "near")))).alias("_first")), "first-lines")
    drop()
    joined = docs.select(*own).withColumn("_doc", _order(F.col(id_col))).withColumn("_text", F.xxhash64(text_col)).join(firsts, ["_doc", "_text"], "left")

    def judged(line: Column, no: Column) -> Column:
        bits = F.try_element_at(F.col("_first"), F.floor(no / 63).cast("int"))
        has = lambda side: F.coalesce(F.call_function("shiftright", bits[side], F.pmod(no, F.lit(63)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(False))
        taken = _taken(line, min_chars, copy_chars)
        return F.struct(line.alias("line"), (~taken | has("stay")).alias("stays"), (taken & has("near")).alias("near"))

    out = joined.withColumn("_judged", F.transform(_lines(F.col(text_col)), judged))
    return out.select(
        *[c for c in own if c != text_col],
        F.when(F.col(text_col).isNotNull(), F.array_join(F.transform(F.filter("_judged", lambda s: s["stays"]), lambda s: s["line"]), "\n")).alias(text_col),
        F.size("_judged").cast("long").alias("n_lines"),
        F.size(F.filter("_judged", lambda s: ~s["stays"])).cast("long").alias("n_removed"),
        F.size(F.filter("_judged", lambda s: s["near"])).cast("long").alias("n_near"),
    ).select(*own, "n_lines", "n_removed", "n_near")
