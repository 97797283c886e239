"""Spelling variants: word pairs one edit apart, by dynamic programming along sorted lists.

Two words one edit apart agree before and after the edit. A shorter word of n code points is cut in two, so each
partner shares its first or its last half at the same end; words meet in lists by such halves. A list of too many
words is cut again, half by half, until all but one code point are shared, so that no list is unbounded and no pair is lost.

A list is sorted. A query runs down it with one row of the edit matrix a prefix length, three cells wide (the
band of one edit). The next word keeps the rows of the prefix it shares with the last one (their LCP), and once every
cell of a row exceeds one edit, all words that share that prefix are skipped.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, materialise, record_batch, text_or_empty

RUN = "[a-zÀ-ÿ]+"  # once A-Z are lower
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLIP = 199  # one run in so many loses a code point
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
LIST_WORDS = 4096  # words of one list, unless they share all but one code point


def words_of(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n`` of the runs of all texts; a null text has none and a null id counts as an empty one."""
    runs = df.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.translate(text_or_empty(text_col), UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"),
    ).where(F.length("run") >= min_length)
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    marked = runs.select("run", h.alias("h")).select("run", "h", F.pmod("h", F.length("run")).cast("int").alias("at"))
    slipped = F.concat(F.substring("run", F.lit(1), F.col("at")), F.substring("run", F.col("at") + 2, F.length("run")))
    word = F.when(F.col("h") % SLIP == 0, slipped).otherwise(F.col("run"))
    counted = marked.select(word.alias("word")).where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= min_count)


def common_prefix(a: str, b: str, known: int = 0) -> int:
    at, most = known, min(len(a), len(b))
    while at < most and a[at] == b[at]:
        at += 1
    return at


def lcps(words: list[str], shared: int) -> list[int]:
    """Of each word with the one before it; ``shared`` for the first, all begin with that many equal code points."""
    return [shared] + [common_prefix(a, b, shared) for a, b in zip(words, words[1:])]


def one_edit(query: str, words: list[str], lcp: list[int], shared: int, start: int = 0) -> tuple[list[int], int]:
    """Places from ``start`` on of the words exactly one edit from ``query``, and how many matrix rows were computed.

    ``words`` are sorted, of one length each not below the query's and at most one above, and share their
    first ``shared`` code points with it. ``rows[d]`` holds the distances of a prefix of d code points to the query's first d - 1, d and d + 1.
    """
    found: list[int] = []
    if start >= len(words):
        return found, 0
    size, length, computed = len(query), len(words[start]), 0
    padded = query + "\0\0"
    rows = [(2, 2, 2)] * (length + 1)
    rows[shared] = (1 if shared else 2, 0, 1)
    at, depth = start, shared
    while True:
        word, alive = words[at], True
        left, middle, right = rows[depth]
        while depth < length:
            c = word[depth]
            new_left = middle + 1
            if depth and left + (c != padded[depth - 1]) < new_left:
                new_left = left + (c != padded[depth - 1])
            new_middle = middle + (c != padded[depth]) if depth < size else 2
            new_middle = min(new_middle, right + 1, new_left + 1)
            new_right = min(right + (c != padded[depth + 1]), new_middle + 1) if depth + 1 < size else 2
            left, middle, right = new_left, new_middle, new_right
            depth += 1
            computed += 1
            rows[depth] = (left, middle, right)
            if left > 1 and middle > 1 and right > 1:
                alive = False
                break
        if alive and (middle if length == size else left) == 1:
            found.append(at)
        dead = depth if not alive else length + 1
        at += 1
        while at < len(words) and lcp[at] >= dead:  # the shared prefix already exceeds one edit
            at += 1
        if at >= len(words):
            return found, computed
        depth = lcp[at]


def _half_lists(words: DataFrame) -> DataFrame:
    """Rows ``word, n, size, a, b``: the lists of words of ``size`` (and one more) that agree outside code points a to b of the shorter."""
    sizes = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("size")).where("size >= 1")
    return _cut(sizes.withColumn("a", F.lit(0)).withColumn("b", F.col("size")))


def _cut(rows: DataFrame) -> DataFrame:
    """Each list's span halved: words that agree up to its middle, and words that agree from there on."""
    middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    halves = F.array(F.struct(middle.alias("a"), F.col("b").alias("b")), F.struct(F.col("a").alias("a"), middle.alias("b")))
    return rows.select("word", "n", "size", F.explode(halves).alias("span")).select("word", "n", "size", "span.a", "span.b").where("a < b")


def _keyed(rows: DataFrame) -> DataFrame:
    tail = F.col("size") - F.col("b")
    return rows.withColumn("head", F.substring("word", F.lit(1), F.col("a"))).withColumn(
        "tail", F.substring("word", F.length("word") - tail + 1, tail)
    )


KEY = ["size", "a", "b", "head", "tail"]


def bounded_lists(words: DataFrame, scratch: Scratch, most: int) -> DataFrame:
    """The rows of all lists, each of at most ``most`` words or with all but one code point shared."""
    rows, done = scratch.stage(_keyed(_half_lists(words)), "lists"), None
    while True:
        wide = rows.where("b - a > 1").groupBy(KEY).count().where(F.col("count") > most).select(*KEY, F.lit(True).alias("wide"))
        wide = scratch.stage(wide, "wide")
        if wide.isEmpty():
            return rows if done is None else done.unionByName(rows)
        marked = rows.join(wide, KEY, "left")
        small = marked.where("wide IS NULL").drop("wide")
        done = small if done is None else done.unionByName(small)
        rows = scratch.stage(_keyed(_cut(marked.where("wide"))), "lists")


def near_pairs(words: DataFrame, scratch: Scratch, *, most: int = LIST_WORDS) -> DataFrame:
    """``word, near, near_n``: every word with each word exactly one edit away, so a pair gives two rows. ``words``: distinct ``word, n``."""
    # Read from the end where the words share more of it, so that a list always starts with its common part.
    turned = F.col("size") - F.col("b") > F.col("a")
    text = F.when(turned, F.reverse("word")).otherwise(F.col("word"))
    lists = bounded_lists(words, scratch, most).select(*KEY, turned.alias("turned"), text.alias("text"), F.length("word").alias("length"), "n")
    order = [*KEY, "length", "text"]
    dealt = lists.repartition(*KEY).sortWithinPartitions(*order)

    def pairs_of(key: tuple, members: list[tuple[int, str, int]]):
        """(shorter or first, its n, other, its n) of one list."""
        size, a, b, turned = key
        split = next((i for i, m in enumerate(members) if m[0] > size), len(members))
        short, long = members[:split], members[split:]
        shared = max(a, size - b)
        texts = [[m[1] for m in part] for part in (short, long)]
        prefix = [lcps(t, shared) for t in texts]
        for i, (_, query, n) in enumerate(short):
            for which, part, start in ((0, short, i + 1), (1, long, 0)):
                for j in one_edit(query, texts[which], prefix[which], shared, start)[0]:
                    u, v = (query[::-1], part[j][1][::-1]) if turned else (query, part[j][1])
                    # A pair may meet in several lists; it counts where its first difference lies.
                    if common_prefix(u, v, a) < b or b == size:
                        yield u, n, v, part[j][2]

    def scan(batches):
        key, last, members = None, None, []
        out: list[tuple] = []

        def flush():
            two_way = [(w, near, near_n) for u, n, v, m in out for w, near, near_n in ((u, v, m), (v, u, n))]
            out.clear()
            columns = list(zip(*two_way)) if two_way else [(), (), ()]
            return record_batch({"word": (columns[0], pa.string()), "near": (columns[1], pa.string()), "near_n": (columns[2], pa.int64())})

        for batch in batches:
            c = batch.to_pydict()
            for row in zip(c["size"], c["a"], c["b"], c["head"], c["tail"], c["turned"], c["length"], c["text"], c["n"]):
                if row[:5] != last:
                    if len(members) > 1:
                        out.extend(pairs_of(key, members))
                    if len(out) > 50_000:
                        yield flush()
                    last, key, members = row[:5], (*row[:3], row[5]), []
                members.append(row[6:])
        if len(members) > 1:
            out.extend(pairs_of(key, members))
        yield flush()

    return dealt.mapInArrow(scan, "word string, near string, near_n long")


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """``word, root`` for the words that have a form. A form has ``RATIO`` times the occurrences, so chains are short; each round doubles the steps."""
    now = scratch.stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        after = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        stepped = now.join(after, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        now = scratch.stage(stepped, "roots")
        moved = not now.where("moved").isEmpty()
        now = now.select("word", "root")
        if not moved:
            return now


def spelling_variants(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO,
    list_words: int = LIST_WORDS,
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of at least ``min_length`` code points and ``min_count`` occurrences.

    Words are the runs of letters of all texts, A-Z made lower; where the CRC of ``id:run`` divides by 199 the run has lost one code point.
    ``form`` is the near word (exactly one code point inserted, deleted or replaced) of most occurrences, of several the first in
    code-point order, if it has at least ``ratio`` times the word's; ``root`` the last of the chain of forms, the word itself if none.
    Null and empty texts have no words, repeated rows count each, null ids count as empty; other columns are not read. An empty table gives no rows.
    """
    scratch = Scratch(df.sparkSession)
    words = scratch.stage(words_of(df, id_col=id_col, text_col=text_col, min_length=min_length, min_count=min_count), "words")
    # Two columns a pair, combined before the shuffle, so a word of many near ones is a row a task.
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    nearest = near_pairs(words, scratch, most=list_words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    common = -F.col("best.less") >= ratio * F.col("n")
    chosen = words.join(nearest, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(common, F.col("best.near")).alias("form"),
        F.when(common, -F.col("best.less")).alias("form_n"),
    )
    chosen = scratch.stage(chosen, "forms")
    roots = _roots(chosen.where("form IS NOT NULL"), scratch)
    out = chosen.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    out = materialise(out, "variants")
    scratch.clear()
    return out
