"""Line dedup: winnowing over hashes of lines, long lines cut at their sentences.

A piece is a line or a sentence of one, with the blanks behind it, so a passage
that stands inside a longer line has pieces of its own. From each piece on, the
shortest stretch of pieces with ``min_words`` words is a window, and the leftmost
piece of least hash in it is its fingerprint. Only these window minima are
selected. A run of ``min_words`` words holds a whole window, so every repeated
run has a fingerprint that repeats. Positions are joined on the repeated
fingerprints, and only there matches are extended, piece by piece: onwards by
the windows that begin at a piece, and back by those that end at one, so that
the windows of a run cover it to both ends. What stands at an earlier position
too is a later copy, and its pieces are deleted.

DataFrame functions only. Documents are cut into chunks of ``CHUNK`` pieces, and
pieces, windows and minima are arrays inside a chunk's row, so nothing is sorted
to find them. Equal fingerprints and equal windows are counted before the
shuffle, so a line in a third of the documents is a few rows a task; the texts
move once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.llm.store import stored, stored_without_shuffles

MIN_WORDS = 10
#: Where a text is cut: before a word, behind a line's end or a sentence's.
CUT_PATTERN = r"(?<=[\n ])(?=[^\x20\x09-\x0D])(?<=\n|[.!?] )"
#: The blank at such a place, in a plain text: a line's end, or a space behind a sentence's.
PLAIN_CUT_PATTERN = r"[\n ](?<![^.!?] )"
BLANKS = " \t\n\x0b\x0c\r"
BLANK_PATTERN = r"[\x20\x09-\x0D]+"
#: Pieces whose windows are found in one row.
CHUNK = 256


def pieces_of(text: Column) -> Column:
    """The lines and sentences of a text; joined they are the text. Only the first one may have no word."""
    return F.split(text, CUT_PATTERN)


def is_plain(text: Column) -> Column:
    """Whether all blanks of a text are single spaces and line ends between its words; what does not need to be looked for in each piece."""
    other = text.contains("  ")
    for blank in BLANKS.replace(" ", "").replace("\n", ""):
        other = other | text.contains(blank)
    return ~(other | F.exists(F.split(text, "\n"), lambda line: (F.ascii(line) <= 32) | line.endswith(" ")))


def without_blanks(piece: Column) -> Column:
    """A piece without the blanks around it; most end in spaces only, which cost less to take off."""
    plain = F.rtrim(piece)
    other = F.ascii(piece) <= 32
    for blank in BLANKS[1:]:
        other = other | plain.endswith(blank)
    return F.when(other, F.trim(piece, F.lit(BLANKS))).otherwise(plain)


def bare_pieces_of(text: Column, plain: Column) -> Column:
    """The pieces of a text without the blanks around them."""
    return F.when(plain, F.split(text, PLAIN_CUT_PATTERN)).otherwise(F.transform(pieces_of(text), without_blanks))


def capped_words(piece: Column, cap: int) -> Column:
    """Words of a piece without blanks around it, at most ``cap``: no window needs to know of more.

    Where words are apart by single spaces, spaces are counted.
    """
    other = piece.contains("  ")
    for blank in BLANKS[1:]:
        other = other | piece.contains(blank)
    split = F.size(F.split(piece, BLANK_PATTERN, cap))
    spaces = F.octet_length(piece) - F.octet_length(F.replace(piece, F.lit(" "), F.lit("")))
    return F.when(piece == "", 0).when(other, split).otherwise(F.least(spaces + 1, F.lit(cap)))


def chunks_of_pieces(docs: DataFrame, min_words: int) -> DataFrame:
    """(chunk, doc, mark, base, own, h, size, at): hashes and windows of the pieces from number ``base`` on.

    ``own`` windows begin in a chunk; the pieces that follow are there to end
    them. ``size`` is the number of pieces of the window from each piece on, NULL
    without one, and ``at`` its minimum's place. doc and mark (a hash of the text)
    name the document. ``chunk`` numbers the rows of a run: store them first.
    """

    def size_from(words: Column, i: Column) -> Column:
        total, found = words, F.when(words == 0, None)
        for n in range(1, min_words + 1):
            found = found.when(total >= min_words, n)
            total = total + F.get("words", i + n)
        return found

    def least(size: Column, i: Column) -> Column:
        first, second, third = (F.get("h", i + n) for n in range(3))  # most windows have few pieces
        two = F.when(first <= second, i).otherwise(i + 1)
        three = F.when(first <= F.least(second, third), i).when(second <= third, i + 1).otherwise(i + 2)
        window = F.slice("h", i + 1, size)
        more = (i + F.array_position(window, F.array_min(window)) - 1).cast("int")
        return F.when(size == 1, i).when(size == 2, two).when(size == 3, three).when(size.isNotNull(), more)

    # the text and not its pieces, as a filter of the pieces would cut the text once more
    rows = docs.filter("text is not null").select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("mark"), "text", is_plain(F.col("text")).alias("plain"))
    rows = rows.select("doc", "mark", "plain", bare_pieces_of(F.col("text"), F.col("plain")).alias("pieces"))
    # a window has min_words pieces at most, as every piece but the first has a word
    bases = F.sequence(F.lit(0), F.size("pieces") - 1, F.lit(CHUNK))
    rows = rows.withColumn("all", F.size("pieces")).select("doc", "mark", "plain", "all", "pieces", F.explode(bases).alias("base"))
    part = F.slice("pieces", F.col("base") + 1, F.lit(CHUNK + min_words + 1))
    rows = rows.select("doc", "mark", "plain", "base", F.least(F.lit(CHUNK), F.col("all") - F.col("base")).alias("own"), part.alias("part"))
    plain_words = F.transform("part", lambda p: F.size(F.split(p, " ", min_words)))
    rows = rows.withColumns({
        "h": F.transform("part", lambda p: F.xxhash64(p)),
        "words": F.when(F.col("plain"), plain_words).otherwise(F.transform("part", lambda p: capped_words(p, min_words))),
    })
    # one window more than its own, to know where the last one's matches are extended to
    rows = rows.withColumn("size", F.slice(F.transform("words", size_from), F.lit(1), F.col("own") + 1))
    rows = rows.withColumn("at", F.transform(F.slice("size", F.lit(1), F.col("own")), least))
    return rows.select(F.monotonically_increasing_id().alias("chunk"), "doc", "mark", "base", "own", "h", "size", "at")


def extended(chunks: DataFrame) -> DataFrame:
    """(doc, mark, first, more, a, b): the windows whose minimum is in ``hits``, and their extensions, with 96 bits of content.

    From one piece on these are the window and those that end before the next
    piece's window does, so every piece with enough words before it ends one.
    """

    def ends(i: Column) -> Column:
        end = i + F.get("size", i) - 1
        following = i + F.get("size", i + 1) - 1  # before the next piece's window ends
        return F.struct(i.alias("i"), end.alias("end"), F.greatest(end, F.coalesce(following, F.size("h") - 1)).alias("last"))

    starts = F.filter(F.sequence(F.lit(0), F.col("own") - 1), lambda i: F.array_contains("hits", F.get("at", i)))
    rows = chunks.select("doc", "mark", "base", "h", F.explode(F.transform(starts, ends)).alias("w"))
    rows = rows.select("doc", "mark", "base", "h", "w", F.explode(F.sequence("w.end", "w.last")).alias("j"))
    content = F.slice("h", F.col("w.i") + 1, F.col("j") - F.col("w.i") + 1)
    return rows.select(
        "doc", "mark", (F.col("base") + F.col("w.i")).alias("first"), (F.col("j") - F.col("w.i")).alias("more"),
        F.xxhash64(content).alias("a"), F.hash(content).alias("b"),
    )


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, mark, n_pieces, runs): the stretches of pieces of each document that stand earlier already, in order, none touching another, or NULL."""
    chunks = stored(chunks_of_pieces(docs, min_words), "line-pieces")
    minima = chunks.select("chunk", "h", F.explode(F.array_distinct(F.filter("at", lambda p: p.isNotNull()))).alias("at"))
    # 48 bits of a hash are enough here: what meets by chance is told apart by its windows
    minima = minima.select("chunk", "at", F.get("h", F.col("at")).bitwiseAND(F.lit((1 << 48) - 1)).alias("print"))
    prints = minima.groupBy("print").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("print")
    hits = minima.join(prints, "print", "left_semi").groupBy("chunk").agg(F.collect_set("at").alias("hits"))
    near = stored_without_shuffles(extended(chunks.join(hits, "chunk")), "line-windows")
    place = F.struct("doc", "mark", "first")
    firsts = near.groupBy("a", "b").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("a", "b", "place")
    later = near.join(firsts, ["a", "b"]).filter(place > F.col("place")).select("doc", "mark", "first", (F.col("first") + F.col("more")).alias("last"))

    order = Window.partitionBy("doc", "mark").orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    later = later.withColumn("new", F.when(F.col("first") <= reach + 1, 0).otherwise(1))
    later = later.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = later.groupBy("doc", "mark", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    runs = runs.groupBy("doc", "mark").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))
    sizes = chunks.groupBy("doc", "mark").agg(F.max(F.col("base") + F.col("own")).alias("n_pieces"))
    runs = runs.select(F.col("doc").alias("of_doc"), F.col("mark").alias("of_mark"), "runs")
    return sizes.join(runs, F.col("doc").eqNullSafe(F.col("of_doc")) & (F.col("mark") == F.col("of_mark")), "left").select("doc", "mark", "n_pieces", "runs")


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without later copies of runs of lines and sentences, and with n_pieces and removed_pieces.

    Runs of at least ``min_words`` words count, in the order of (doc_id, piece),
    across documents and inside one; the first place of a run stays. Blanks go
    with the piece before them and count for nothing when pieces are compared.
    What a run shares with another copy beyond its whole pieces stays. A NULL
    text stays NULL with 0 pieces; an empty one is one piece; a text that loses
    all its pieces becomes empty. Texts of any length are read whole, in chunks.
    NULL as doc_id comes first. Rows that agree in doc_id and text are one
    document and get the same result, as do rows of the same doc_id with
    different texts each by its own. An empty table stays empty. If the table has
    n_chars, it becomes the new text's length where something was deleted. Other
    columns pass through; ones called n_pieces or removed_pieces are replaced.
    """
    runs = repeated_runs(docs, min_words)
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_keep_{i}") for i, c in enumerate(docs.columns)])
    text, doc_id = (f"_keep_{docs.columns.index(c)}" for c in ("text", "doc_id"))
    same = F.col(doc_id).eqNullSafe(F.col("doc")) & (F.xxhash64(text) == F.col("mark"))
    joined = rows.join(runs, same, "left")

    n_runs = F.size("runs")
    kept = F.transform(
        F.sequence(F.lit(0), n_runs),
        lambda i: F.struct(
            F.when(i == 0, 0).otherwise(F.try_element_at("runs", F.greatest(i, F.lit(1)))["last"] + 1).alias("first"),
            F.when(i == n_runs, F.size("pieces")).otherwise(F.try_element_at("runs", i + 1)["first"]).alias("end"),
        ),
    )
    left = F.flatten(F.transform("kept", lambda k: F.slice(F.col("pieces"), k["first"] + 1, k["end"] - k["first"])))
    removed = F.aggregate("runs", F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1)
    joined = joined.withColumn("pieces", F.when(F.col("runs").isNotNull(), pieces_of(F.col(text))))
    joined = joined.withColumn("kept", F.when(F.col("runs").isNotNull(), kept))
    joined = joined.withColumn("new", F.when(F.col("runs").isNull(), F.col(text)).otherwise(F.array_join(left, "")))
    columns = {c: F.col(f"_keep_{i}") for i, c in enumerate(docs.columns)} | {"text": F.col("new")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("runs").isNull(), columns["n_chars"]).otherwise(F.length("new").cast("long"))
    columns["n_pieces"] = F.coalesce("n_pieces", F.lit(0)).cast("long")
    columns["removed_pieces"] = F.coalesce(removed, F.lit(0)).cast("long")
    return joined.select(*[c.alias(n) for n, c in columns.items()])
