"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Lines within a few edits of each other are linked. A line cut into ``edits + 1`` segments keeps one of them whole under so few
edits, so an index of segments, keyed by number, line length and content, meets the substrings of equal or longer lines at the
places that the edits allow. Candidates are verified by a banded bit-parallel edit distance. Of each class of linked lines
(components) only the first occurrence stays.

Distinct lines are stored once, with a number each; keys come from them, so a line that occurs a million times is indexed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.llm._common import drop_shuffles, release, stored, table
from helixspark.llm.ngram_join import components

#: Edits, characters from which lines are compared by edits (shorter ones: exactly), index rows of a key that are joined
#: directly, hubs of a key, rounds of hubs. The last three only choose between ways to the same classes.
EDITS, LEAST_CHARS, DIRECT, HUBS, ROUNDS = 2, 30, 32, 8, 2
#: Letters whose counts are compared before lines of a crowded key are paired.
LETTERS = "etaoinsrhldu"


def within(a: str, b: str, edits: int) -> F.Column:
    """Whether two columns of characters (arrays) are at most so many edits apart.

    Bit d + edits of word e says that the first j + d characters of a and the first j of b are at most e edits apart; only
    2 * edits + 1 diagonals can matter, so a word holds the whole band. A character of b moves all words at once, until no
    diagonal is left.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    hits = " | ".join(f"if(get({a}, j + {d - edits}) <=> get({b}, j), {1 << d}, 0)" for d in range(width))
    words = ["s.r0 & h"]
    for e in range(1, edits + 1):
        words.append(f"((s.r{e} & h) | s.r{e - 1} | shiftright(s.r{e - 1}, 1) | (shiftleft(n{e - 1}, 1) & {full}))")
    # The new words build on one another, so that each is named once by a one-element transform.
    body = "named_struct(" + ", ".join(f"'r{e}', n{e}" for e in range(edits + 1)) + ")"
    for e in range(edits, -1, -1):
        body = f"transform(array({words[e]}), n{e} -> {body})[0]"
    body = f"transform(array({hits}), h -> {body})[0]"
    last = f"aggregate(sequence(0, size({b}) - 1), named_struct({', '.join(x for e in range(edits + 1) for x in (repr(f'r{e}'), str(((1 << (e + 1)) - 1) << edits & full)))}), (s, j) -> if(s.r{edits} = 0, s, {body}), s -> s.r{edits})"
    return F.expr(f"abs(size({a}) - size({b})) <= {edits} and (size({b}) = 0 or size({a}) = 0 or ({last} & shiftleft(1, size({a}) - size({b}) + {edits})) <> 0)")


def differing(pairs: DataFrame) -> DataFrame:
    """``a, b, x, y`` with only what differs of the lines x and y: their characters, backwards, without the common head and tail.

    None of that changes the edit distance. Halving finds their lengths, by comparing whole substrings.
    """
    step = "if(n + shiftleft(1, k) <= length(x) and n + shiftleft(1, k) <= length(y) and substring(x, n + 1, shiftleft(1, k)) = substring(y, n + 1, shiftleft(1, k)), n + shiftleft(1, k), n)"
    grow = f"aggregate(sequence(int(log2(greatest(length(x), 1))), 0), 0, (n, k) -> {step})"

    def settled(rows: DataFrame, x: str, y: str, n: str) -> DataFrame:
        # A generator keeps the optimizer from writing these expressions out at each of their uses.
        return rows.select("a", "b", F.expr(f"inline(array(struct({x} as x, {y} as y, {n} as n)))"))

    out = settled(pairs, "x", "y", grow)
    out = settled(out, "reverse(substring(x, n + 1))", "reverse(substring(y, n + 1))", "0")
    out = settled(out, "x", "y", grow)
    chars = "if(length({0}) = n, array(), split(substring({0}, n + 1), ''))"
    return settled(out, chars.format("x"), chars.format("y"), "0").select("a", "b", "x", "y")


def text_lines(docs: DataFrame, least: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, u, line_no, line, s, t, len``: trimmed lines long enough, their two hashes; u is the hash of the row's text.

    A row is known by its id and its text: rows that repeat both are one document.
    """
    text = F.col(text_col).cast("string")
    lines = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("u"), F.posexplode(F.split(text, "\n")).alias("line_no", "line")).where("doc_id is not null")
    # Few lines have white space at their ends, and trimming a set of characters reads the whole line.
    blank = " or ".join(f"{f}(line, '{c}')" for f in ("startswith", "endswith") for c in (" ", "\\t", "\\r"))
    lines = lines.withColumn("line", F.expr(rf"case when {blank} then trim(BOTH ' \t\r' FROM line) else line end"))
    lines = lines.withColumn("len", F.length("line")).where(F.col("len") >= least)
    return lines.withColumns({"s": F.xxhash64("line"), "t": F.xxhash64("line", F.lit("second"))})


def distinct_lines(docs: DataFrame, least: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``line_id, s, t, len, first, k, line`` of each distinct line, stored: its number, first occurrence and how often it occurs."""
    lines = text_lines(docs, least, id_col, text_col)
    once = lines.groupBy("s", "t", "len").agg(F.min(F.struct("doc_id", "u", "line_no")).alias("first"), F.count("*").alias("k"), F.first("line").alias("line"))
    return stored(once.select(F.monotonically_increasing_id().alias("line_id"), "s", "t", "len", "first", "k", "line"), "lines")


def segment_rows(lines: DataFrame, edits: int, probe: bool) -> DataFrame:
    """``line_id, key, i, gap, own``: of each line its index entries, or the substrings by which it looks for equal or shorter lines.

    ``i`` is the segment, ``gap`` how much shorter the line looked for is, ``own`` whether the key is the line's own index entry.
    """
    places = []
    for gap in range(edits + 1 if probe else 1):
        for i in range(edits + 1):
            for p in range(max(-i, gap - (edits - i)), min(i, gap + (edits - i)) + 1) if probe else (0,):
                places.append(f"struct({i} as i, {gap} as gap, {p} as p)")
    # The places are exploded before any key is made: one short expression, which stays compiled.
    rows = lines.select("line_id", "line", F.col("len").alias("n"), F.expr(f"inline(array({', '.join(places)}))")).withColumn("n", F.expr("n - gap"))
    cut = lambda k: f"cast(({k}) * n div {edits + 1} as int)"
    key = F.expr(f"xxhash64(i, n, substring(line, {cut('i')} + 1 + p, {cut('i + 1')} - {cut('i')}))")
    return rows.select("line_id", key.alias("key"), F.col("i").cast("tinyint").alias("i"), F.col("gap").cast("tinyint").alias("gap"), (F.expr("gap = 0 and p = 0")).alias("own"))


def piece_rows(rows: DataFrame, edits: int, probe: bool) -> DataFrame:
    """``rows`` with ``key2``: what their lines have outside the segment of ``key``, cut in ``edits + 1`` pieces.

    Two lines that keep a segment and are within the edits keep one of these pieces too, at most ``edits`` places off.
    ``rows`` have ``line, key, i, gap``.
    """
    shifts = range(-edits, edits + 1) if probe else (0,)
    some = rows.withColumn("n", F.expr("length(line) - gap")).select("*", F.expr(f"inline(array({', '.join(f'struct({j} as j, {p} as p)' for j in range(edits + 1) for p in shifts)}))"))
    # The segment lies between start and stop; the pieces are cut from the text without it, and one that spans it joins its two sides.
    start, width = f"cast(i * n div {edits + 1} as int)", f"(cast((i + 1) * n div {edits + 1} as int) - cast(i * n div {edits + 1} as int))"
    some = some.withColumns({"start": F.expr(start), "width": F.expr(width)})
    # Pieces left of the segment come first: as many as there are segments before it, or all if none comes after it.
    some = some.withColumn("before", F.expr(f"if(i = {edits}, {edits + 1}, int(i))"))
    # A greatest() keeps the side that a case doesn't take from dividing by 0.
    end = lambda j: f"case when j < before then cast({j} * start div greatest(before, 1) as int) else start + width + cast(({j} - before) * (n - start - width) div greatest({edits + 1} - before, 1) as int) end"
    some = some.withColumns({"lo": F.expr(end("j")), "hi": F.expr(end("(j + 1)"))}).where("lo + p >= 0")
    return some.withColumn("key2", F.expr("xxhash64(key, j, substring(line, lo + p + 1, hi - lo))")).drop("n", "j", "p", "start", "width", "before", "lo", "hi", "line")


def line_links(lines: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS) -> DataFrame:
    """``node, component`` of the lines of ``distinct_lines`` that have others within the edits: the least number of their class."""
    long = lines.where(F.col("len") >= least).select("line_id", "line", "len")
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A key's index entries as their number and one of them: most keys have one, that of the line that asks.
    index = segment_rows(long, edits, False).groupBy("key").agg(F.count("*").alias("k"), F.min("line_id").alias("one"))
    hits = segment_rows(long, edits, True).join(index, "key").where("k > 1 or line_id <> one")
    hits = stored(hits, "hits")
    drop_shuffles()
    alone, crowd = hits.where("k = 1").select(F.least("line_id", "one").alias("a"), F.greatest("line_id", "one").alias("b")), hits.where(f"k > {DIRECT}")
    met = hits.select("line_id").union(alone.select(F.explode(F.array("a", "b")))).distinct()
    # One plan at every size: few lines are met, but how many has no bound that a broadcast could rest on.
    texts = stored(long.select("line_id", "line").join(met.hint("merge"), "line_id", "left_semi"), "texts")
    drop_shuffles()
    counts = F.struct(*(F.expr(f"length(line) - length(replace(line, '{c}', ''))").alias(c) for c in LETTERS))

    def met_pairs(rows: DataFrame) -> DataFrame:
        """``a, b``: lines of one key and one class's border that agree on a second key, from what surrounds the segment.

        ``rows`` are hits with ``label`` and ``most``, the key's largest class: its lines aren't paired with each other.
        """
        rows = rows.join(texts, "line_id").withColumn("c", counts)
        x = piece_rows(rows, edits, True).select("key2", F.col("line_id").alias("a"), F.col("label").alias("la"), (F.col("label") != F.col("most")).alias("ma"), F.col("c").alias("ca"))
        y = piece_rows(rows.where("own"), edits, False).select("key2", F.col("line_id").alias("b"), F.col("label").alias("lb"), (F.col("label") != F.col("most")).alias("mb"), F.col("c").alias("cb"))
        # An edit changes these counts by two at most.
        alike = f"{' + '.join(f'abs(ca.{c} - cb.{c})' for c in LETTERS)} <= {2 * edits}"
        return x.join(y, "key2").where(f"(ma or mb) and la <> lb and {alike}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    # Lines under one key are few here, so all are paired: each is a class of its own.
    light = hits.where(f"k between 2 and {DIRECT}").select("line_id", "key", "i", "gap", "own", F.col("line_id").alias("label"), F.lit(-1).cast("long").alias("most"))
    pairs = stored(met_pairs(light).union(alone.distinct()).distinct(), "pairs")

    def verified(some: DataFrame) -> DataFrame:
        # Verifying costs more than moving ids, and stored pairs may be few files.
        x, y = texts.select(F.col("line_id").alias("a"), F.col("line").alias("x")), texts.select(F.col("line_id").alias("b"), F.col("line").alias("y"))
        both = some.repartition(tasks, "a", "b").join(x, "a").join(y, "b").where(F.abs(F.length("x") - F.length("y")) <= edits)
        return differing(both).where(within("x", "y", edits)).select("a", "b")

    links = stored(verified(pairs), "links")
    labels = stored(components(links), "labels")
    release(links)

    def joined(some: DataFrame) -> None:
        """Link those of ``a, b`` that are near. A class and its number stand for all earlier links."""
        nonlocal labels
        new = stored(verified(some), "links")
        if not new.isEmpty():
            old, labels = labels, stored(components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(new)), "labels")
            release(old)
        release(new)

    if not crowd.isEmpty():
        labelled = lambda rows: rows.join(labels, rows["line_id"] == labels["node"], "left").select(rows["*"], F.coalesce("component", "line_id").alias("label"))
        # Many lines share a segment: they meet a few hubs, then those outside the largest class of the key meet the rest.
        for k in range(ROUNDS):
            rows = labelled(crowd.select("key", "line_id", "own"))
            hubs = rows.groupBy("key", "own", F.pmod(F.xxhash64("line_id", F.lit(k)), F.lit(HUBS)).alias("nth")).agg(F.min_by(F.struct("line_id", "label"), F.xxhash64("line_id", "key", F.lit(k))).alias("h"))
            hubs = hubs.select("key", F.col("own").alias("other"), F.col("h.line_id").alias("b"), F.col("h.label").alias("to"))
            joined(rows.join(hubs, "key").where("(own or other) and label <> to").groupBy(F.col("line_id").alias("a")).agg(F.min_by("b", F.xxhash64("line_id", "b")).alias("b")))
        # Keys whose lines lie in several classes. Lines are paired by a second key, from what surrounds the segment.
        rows = labelled(crowd.select("key", "line_id", "i", "gap", "own"))
        most = rows.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("most"), F.count("*").alias("n")).where("n > 1").drop("n")
        joined(met_pairs(rows.join(most, "key")))
    release(hits, pairs, texts)
    return labels


def line_classes(docs: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS, id_col: str = "doc_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """``s, t, doc_id, u, line_no``: of each line that occurs again, or has a near copy, the one occurrence that stays.

    That is its class's first by id, text and number. Lines under ``least`` characters are left alone, or if ``short`` compared
    exactly; blank ones are always left alone.
    """
    lines = distinct_lines(docs, 1 if short else least, id_col, text_col)
    drop_shuffles()
    labels = line_links(lines, edits, least)
    known = lines.select("line_id", "s", "t", "first", "k").join(labels, F.col("line_id") == F.col("node"), "left").where("k > 1 or node is not null")
    near = known.where("node is not null").groupBy("component").agg(F.min("first").alias("stays"))
    out = known.join(near, "component", "left").select("s", "t", F.coalesce("stays", "first").alias("first"))
    out = stored(out.select("s", "t", "first.*"), "stays")
    release(lines, labels)
    return out


def dropped_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS, id_col: str = "doc_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """``doc_id, u, dropped``: sorted numbers (from 0) of the lines that go, for rows that lose any (u: hash of the row's text)."""
    stays = line_classes(docs, edits, least, id_col, text_col, short).select("s", "t", F.struct("doc_id", "u", "line_no").alias("kept"))
    lines = text_lines(docs, 1 if short else least, id_col, text_col).select("doc_id", "u", "line_no", "s", "t")
    gone = lines.join(stays, ["s", "t"]).where("struct(doc_id, u, line_no) <> kept")
    return gone.groupBy("doc_id", "u").agg(F.array_sort(F.collect_set("line_no")).alias("dropped"))


def dedup_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS, id_col: str = "doc_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """The input's rows and columns with repeated and nearly repeated lines gone from the text; ``n_chars`` is the new length.

    Every row stays, if only with an empty text. Null texts stay null; rows with a null id stay as they are. Rows that share an
    id but not the text are documents of their own; rows that repeat both are one, and each keeps what that one keeps. White
    space at a line's ends doesn't count; ties have no say, as (id, text's hash, line number) orders all. An empty table gives
    an empty result. Columns of any name go through: the work is done beside them.
    """
    gone = dropped_lines(docs, edits, least, id_col, text_col, short).select(F.struct("doc_id", "u").alias("row"), "dropped")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("kept"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("u"))
    out = whole.join(gone.select("row.doc_id", "row.u", "dropped"), ["doc_id", "u"], "left")
    text = F.col("kept").getField(text_col)
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("dropped", i)), "\n")
    new = {text_col: F.when(F.col("dropped").isNull(), text).otherwise(left)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("dropped").isNull(), F.col("kept.n_chars")).otherwise(F.length(new[text_col]).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*((new[c] if c in new else F.col("kept").getField(c)).alias(c) for c in docs.columns))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size = docs.select("doc_id", F.xxhash64("text").alias("u"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    out = size.join(dropped_lines(docs, short=True), ["doc_id", "u"], "left")
    none = F.array().cast("array<int>")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("dropped", none).alias("dropped"))


QUERIES = {"op9_line_dedup": op9_line_dedup}
SQL: dict[str, str] = {}
