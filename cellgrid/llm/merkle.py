"""Document fingerprints: a hash tree over sections and paragraphs, in DataFrame functions only.

A text is cut into sections (after blank lines), these into paragraphs (after line ends), without
dropping a character. A paragraph's digest is the SHA-256 of its text, a section's that of its paragraphs' digests, the root's that
of its sections'. Equal roots mean equal texts; where roots differ, the branches whose digests differ hold the edits.
Paragraphs also carry short hashes of their pieces (sentences, or twelve words of long ones), so that
an edit is located within a long line and texts can be told to be alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialise, text_or_empty

SECTION_END = r"(?<=\n\n)(?=[^\n])"
PARAGRAPH_END = r"(?<=\n)(?=[^\n])"
# Up to twelve words with the white space after them; a word that ends a sentence is the last. Matches cover the text.
PIECE = r"[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]*[^\x20\x09-\x0D.!?][\x20\x09-\x0D]+){0,11}[^\x20\x09-\x0D]*[\x20\x09-\x0D]*"
SIZE_BITS = 16  # of a piece's number, the low ones hold its length in code points


def _piece(piece: Column) -> Column:
    """One long a piece: the upper bits of its hash, then its length (65,535 at most)."""
    size = F.least(F.length(piece), F.lit((1 << SIZE_BITS) - 1)).cast("long")
    return F.shiftleft(F.shiftright(F.xxhash64(piece), SIZE_BITS), SIZE_BITS).bitwiseOR(size)


def sections(text: Column) -> Column:
    """The tree below the root: array of (digest, n_chars, parts: array of paragraphs (digest, n_chars, pieces))."""

    def paragraph(p: Column) -> Column:
        pieces = F.filter(F.regexp_extract_all(p, F.lit(PIECE), F.lit(0)), lambda x: x != "")
        return F.struct(F.sha2(p, 256).alias("digest"), F.length(p).alias("n_chars"), F.transform(pieces, _piece).alias("pieces"))

    def section(ps: Column) -> Column:
        size = F.aggregate(ps, F.lit(0), lambda n, p: n + p["n_chars"])
        return F.struct(F.sha2(F.array_join(ps["digest"], ""), 256).alias("digest"), size.alias("n_chars"), ps.alias("parts"))

    raw = F.transform(F.split(text, SECTION_END, -1), lambda s: F.transform(F.split(s, PARAGRAPH_END, -1), paragraph))
    return F.transform(raw, section)


def root(tree: Column) -> Column:
    return F.sha2(F.array_join(tree["digest"], ""), 256)


def pieces(tree: Column) -> Column:
    """The distinct pieces of a tree."""
    return F.array_distinct(F.flatten(F.transform(F.flatten(tree["parts"]), lambda p: p["pieces"])))


def _weight(piece_list: Column) -> Column:
    return F.aggregate(piece_list, F.lit(0).cast("long"), lambda n, p: n + p.bitwiseAND(F.lit((1 << SIZE_BITS) - 1)))


def likeness(a: Column, b: Column) -> Column:
    """Share of the code points of two lists of distinct pieces that lie in common ones; 1 for two empty lists."""
    both = _weight(a) + _weight(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * _weight(F.array_intersect(a, b)) / both)


def _level(df: DataFrame, old: str, new: str, key) -> DataFrame:
    """Narrows two lists of sibling nodes to what lies between their common first and last nodes.

    Adds to ``skip`` the code points of the common first ones and to ``rest`` those of the last.
    """
    a, b = F.transform(old, key), F.transform(new, key)
    shorter = F.least(F.size(old), F.size(new))

    def common(x: Column, y: Column, most: Column) -> Column:
        first = F.array_position(F.zip_with(F.slice(x, 1, most), F.slice(y, 1, most), lambda p, q: p == q), F.lit(False)).cast("int")
        return F.when(first == 0, most).otherwise(first - 1)

    df = df.withColumn("_head", common(a, b, shorter)).withColumn("_tail", common(F.reverse(a), F.reverse(b), shorter - F.col("_head")))
    sizes = lambda nodes: F.aggregate(nodes, F.lit(0).cast("long"), lambda n, p: n + _size(p, key))
    df = df.withColumn("skip", F.col("skip") + sizes(F.slice(new, 1, F.col("_head"))))
    df = df.withColumn("rest", F.col("rest") + sizes(F.slice(new, F.size(new) - F.col("_tail") + 1, F.col("_tail"))))
    for name in (old, new):
        df = df.withColumn(name, F.slice(name, F.col("_head") + 1, F.size(name) - F.col("_head") - F.col("_tail")))
    return df.drop("_head", "_tail")


def _digest(node: Column) -> Column:
    return node["digest"]


def _itself(node: Column) -> Column:
    return node


def _size(node: Column, key) -> Column:
    return node["n_chars"].cast("long") if key is _digest else node.bitwiseAND(F.lit((1 << SIZE_BITS) - 1))


def locate_edits(df: DataFrame, old_text: str, new_text: str) -> DataFrame:
    """Adds ``same``, and ``old_start, old_end, new_start, new_end``: the code points, end exclusive, that hold every edit.

    The trees are followed down from their roots: sections, then paragraphs, then pieces, past whatever branches agree
    at both ends. Spans are empty where texts are equal, and where one text only has more pieces they are empty in the other.
    Null texts count as empty. Pieces of more than 65,535 code points have no exact length: there the span is that of their paragraphs.
    ``df`` has none of the added columns.
    """
    names = df.columns
    out = df.withColumn("_old", sections(text_or_empty(old_text))).withColumn("_new", sections(text_or_empty(new_text)))
    out = out.withColumn("same", root(F.col("_old")) == root(F.col("_new"))).withColumn("skip", F.lit(0).cast("long")).withColumn("rest", F.col("skip"))
    out = _level(out, "_old", "_new", _digest)
    for c in ("_old", "_new"):
        out = out.withColumn(c, F.flatten(F.col(c)["parts"]))
    out = _level(out, "_old", "_new", _digest)
    for c in ("_old", "_new"):
        low = F.flatten(F.transform(c, lambda p: p["pieces"]))
        exact = F.forall(F.col(c), lambda p: F.forall(p["pieces"], lambda x: x.bitwiseAND(F.lit((1 << SIZE_BITS) - 1)) < (1 << SIZE_BITS) - 1))
        out = out.withColumn(f"{c}_exact", exact).withColumn(c, low)
    exact = F.col("_old_exact") & F.col("_new_exact")
    out = out.withColumn("_old", F.when(exact, F.col("_old")).otherwise(F.array())).withColumn("_new", F.when(exact, F.col("_new")).otherwise(F.array()))
    out = _level(out, "_old", "_new", _itself)
    ends = [(F.length(text_or_empty(c)).cast("long") - F.col("rest")) for c in (old_text, new_text)]
    return out.select(
        *names, "same", F.col("skip").alias("old_start"), ends[0].alias("old_end"), F.col("skip").alias("new_start"), ends[1].alias("new_end"),
    )


def _followers(docs: DataFrame) -> DataFrame:
    """Stage table ``sender, target, take, alone, least``: each id with the id before it, to which it lends its first ``take`` code points.

    Ids are ordered in range partitions, and the last of each is joined to the first of the next one: a row a
    partition is all that meets in one task.
    """
    ids = docs.groupBy("id").agg(
        F.max(F.length("text")).alias("longest"), F.count(F.lit(1)).alias("rows"), F.min(F.xxhash64("text")).alias("least")
    )
    ranged = materialise(ids.repartitionByRange(F.col("id").asc_nulls_last()).withColumn("block", F.spark_partition_id()), "ids")
    order = F.col("id").asc_nulls_last()
    inside = Window.partitionBy("block").orderBy(order)
    # Of a block's rows only the last has no follower there; a follower can be the null id, so it is a struct.
    mark = F.struct("id", "rows", "least")
    led = ranged.select("block", "id", "longest", F.lead(mark).over(inside).alias("next"), F.row_number().over(inside).alias("place"), mark.alias("own"))
    heads = led.where("place = 1").select("block", F.col("own").alias("head"))  # a row a partition
    everything = Window.orderBy("block")
    around = heads.select(
        F.col("block").alias("of"),
        F.coalesce(F.lead("head").over(everything), F.first("head").over(everything)).alias("head"),
    )
    joined = led.join(F.broadcast(around), F.col("block") == F.col("of"), "left").withColumn("next", F.coalesce("next", "head"))
    return materialise(joined.select(
        F.col("next.id").alias("sender"), F.col("id").alias("target"), F.floor(F.col("longest") / 4).cast("int").alias("take"),
        (F.col("next.rows") == 1).alias("alone"), F.col("next.least").alias("least"),
    ), "followers")


def edited_text(text: Column, next_start: Column) -> Column:
    """The last floor(n / 4) code points replaced by as many first ones of the next text (or all it has)."""
    n = F.length(text)
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - quarter), F.substring(next_start, F.lit(1), quarter))


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row.

    Fingerprints are the roots of the hash trees, in hex. The next document is that of the next greater id, null ids last, after the last
    id the first; rows of one id share it, and of several texts with that next id the one with the least 64-bit hash stands for it.
    A lone id is its own next. Null texts count as empty; an empty text has nothing to replace, and two empty texts are alike by 1.
    ``near_*`` are ``likeness`` of the pieces of the trees. Repeated rows each give a row; other columns are left out; an
    empty table gives no rows.

    Texts shuffle once, by id, for both joins. What a text gets from its follower is no more than a quarter of its own length, and pieces.
    """
    docs = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    followers = _followers(docs)
    lent = docs.join(followers, F.col("id").eqNullSafe(F.col("sender"))).select(
        "target", "alone", "least", "text", F.substring("text", F.lit(1), F.col("take")).alias("start")
    )
    columns = ["target", "start", pieces(sections(F.col("text"))).alias("next_pieces")]
    # Rows of one id that stand for it are equal in text, so any of them will do.
    stands = F.xxhash64("text").bitwiseXOR(F.col("least")) == 0  # not an equality of the two, which would become a join key of its own
    several = lent.where(~F.col("alone") & stands).select(columns).dropDuplicates(["target"])
    received = lent.where("alone").select(columns).unionByName(several)
    met = docs.join(received, F.col("id").eqNullSafe(F.col("target"))).withColumn("edited", edited_text(F.col("text"), F.col("start")))
    trees = met.select(
        "id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "next_pieces",
        sections(F.col("text")).alias("tree"), sections(F.col("edited")).alias("edited_tree"),
    ).withColumn("pieces", pieces(F.col("tree"))).withColumn("edited_pieces", pieces(F.col("edited_tree")))
    return trees.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", root(F.col("tree")).alias("fingerprint"),
        root(F.col("edited_tree")).alias("edited_fingerprint"),
        likeness(F.col("pieces"), F.col("edited_pieces")).alias("near_edited"), likeness(F.col("pieces"), F.col("next_pieces")).alias("near_next"),
    )
