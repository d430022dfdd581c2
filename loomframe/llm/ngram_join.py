"""N-gram Jaccard join by vertical partitioning (Rong et al., "Fast and scalable distributed set similarity joins", ICDE 2017).

Every document is its set of word shingles in one global order: ordinary shingles by hash, then those found to be
frequent, by frequency. The order is cut into fragments. Candidates come from the fragments of the prefixes, overlaps
are counted in each fragment on its own, and the partial counts are summed per pair, which gives exact intersections.

How groups of copies stay cheap, without dropping a link:

* equal sets are one class before anything is joined, so thousands of exact copies are one vertex;
* a pair above the threshold shares a shingle among the first ``n - ceil(t n) + 1`` of either set, in any global order,
  so only prefixes are exchanged, and frequent shingles stand last and rarely reach them;
* a prefix shingle that no second class has in its prefix bounds what its document can share with one whose prefix ends
  later in the order, and each one that stands before the first common one bounds it for both; the bounds discard pairs
  that share boilerplate alone before they are made;
* in a posting list of over ``hot`` classes, the members are first compared to the list's most central member. Only
  members that this leaves in different components are compared with each other, in blocks of bounded size that are dealt
  over the tasks: a link inside a component changes nothing in the result.

Texts are exchanged only for the classes of candidate pairs: a Bloom filter of bounded size drops the others before the
exchange, and what it lets pass by mistake is dropped by the join that follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .stash import Scratch, connected_components
from .words import chunks, mix, shingle_hashes, shingle_sets, spans, word_hashes

#: At most so many frequent shingles are told to every task (16 bytes each); others only lose the benefit of standing last.
FREQUENT = 1 << 19
#: A shingle counts as frequent from this many documents on.
OFTEN = 64
#: Posting lists of more classes are joined through their centre first; shorter ones give all of their pairs.
HOT = 64
#: Shingles that are counted together before what repeats among them is summed up.
RUN = 4_000_000
#: Leading bits of a shingle that name its fragment of the order when prefixes are exchanged.
FRAGMENT_BITS = 16
#: Members of a hot list in one block of those that are compared with all others.
BLOCK = 4096
#: Bits of the Bloom filter over the rows whose texts are needed, at most: 16 MB, told to every task.
BLOOM_BITS = 27
#: Places in the order below this are ordinary shingles' (their hash without two bits), the others are frequent ones'.
_ORDINARY = 1 << 62


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _frequent(docs: DataFrame, text: str, size: int) -> DataFrame:
    """Shingles with a lower bound of the number of documents that hold them: what repeats within a run of documents."""

    def repeats(seen: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        hashes = np.concatenate(seen)
        seen.clear()
        hashes.sort()
        edge = np.diff(np.concatenate([[0], (hashes[1:] == hashes[:-1]).view(np.int8), [0]]).astype(np.int8))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(first):
            yield pa.RecordBatch.from_arrays([_signed(hashes[first]), pa.array(last - first + 1)], names=["token", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = [], 0
        for batch in batches:
            for _, _, off, data in chunks(batch.column(0)):
                starts, ends, _ = spans(off, data)
                seen.append(shingle_hashes(word_hashes(data, starts, ends), size))
                held += len(seen[-1])
                if held > RUN:
                    yield from repeats(seen)
                    held = 0
        if seen:
            yield from repeats(seen)

    return docs.select(text).mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _prefixes(docs: DataFrame, key: str, text: str, size: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """For each row: its hash, the set's size, two 64-bit signatures of the set, its prefix in the global order, and where that ends.

    frequent: the frequent shingles from the rarest on. A prefix that ends earlier in the order never has the larger
    ``last``; two ends may have the same.
    """
    by_hash = np.argsort(frequent, kind="stable")
    known = frequent[by_hash]

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two, ends, heads, lasts = [], [], [], [0], [], []
            for _, hashes in shingle_sets(batch.column(1), size):
                n.append(len(hashes))
                for signature, column in zip(_signatures(hashes), (one, two), strict=True):
                    column.append(signature)
                k = len(hashes) - -(-percent * len(hashes) // 100) + 1 if len(hashes) else 0
                if len(known) and k:
                    at = np.searchsorted(known, hashes)
                    at[at == len(known)] = 0
                    last = known[at] == hashes
                    head = hashes[~last][:k]
                    if len(head) < k:
                        ranks = np.sort(by_hash[at[last]])[: k - len(head)]
                        head = np.concatenate([head, frequent[ranks]])
                        lasts.append(_ORDINARY + int(ranks[-1]))
                    else:
                        lasts.append(int(head[-1]) >> 2)
                else:
                    head = hashes[:k]
                    lasts.append(int(head[-1]) >> 2 if k else 0)
                heads.append(head)
                ends.append(ends[-1] + len(head))
            heads = np.concatenate(heads) if heads else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(n, pa.int64()),
                    _signed(np.array(one, np.uint64)),
                    _signed(np.array(two, np.uint64)),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _signed(heads)),
                    pa.array(lasts, pa.int64()),
                ],
                names=["id", "h", "n", "s1", "s2", "prefix", "last"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), text, _row_hash(key, text)).mapInArrow(
        prefix, f"id {kind}, h long, n long, s1 long, s2 long, prefix array<long>, last long"
    )


def _row_hash(key: str, text: str):
    """A hash of a row: rows that repeat have one."""
    return F.xxhash64(key, text).alias("h")


def _repeated(tokens: DataFrame) -> DataFrame:
    """The rows (token, c, at) whose token stands in another row of its fragment too: equal neighbours of an external sort."""

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None  # the last token, and its row as long as no equal one was seen
        for batch in batches:
            if not batch.num_rows:
                continue
            token = batch.column(0).to_numpy()
            same = np.zeros(len(token) + 1, bool)
            same[1:-1] = token[1:] == token[:-1]
            same[0] = last is not None and token[0] == last
            if same[0] and held is not None:
                yield held
            keep = same[:-1] | same[1:]
            if keep.any():
                yield batch.filter(pa.array(keep))
            last, held = token[-1], None if keep[-1] else batch.slice(len(token) - 1)

    fragment = F.shiftrightunsigned("token", 64 - FRAGMENT_BITS)
    rows = tokens.select("token", "c", "at").repartition(fragment).sortWithinPartitions("token")
    return rows.mapInArrow(neighbours, "token long, c long, at int")


def _signatures(hashes: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Two independent 64-bit signatures of a set, whatever its order."""
    if not len(hashes):
        return np.uint64(0), np.uint64(0)
    return (
        np.add.reduce(mix(hashes), dtype=np.uint64),
        np.bitwise_xor.reduce(mix(hashes ^ np.uint64(0x5851F42D4C957F2D))),
    )


def _segments(rows: DataFrame, size: int, fragments: int) -> DataFrame:
    """The sets of the rows (c, s1, s2, text) cut at fixed hashes: (c, fragment, tokens). Rows of other sets are left out."""
    pivots = (np.arange(1, fragments, dtype=np.float64) / fragments * 2.0**64).astype(np.uint64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, s1, s2 = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3))
            keys, parts, lengths, tokens = [], [], [], []
            for row, hashes in shingle_sets(batch.column(3), size):
                if _signatures(hashes) == (s1[row], s2[row]):
                    length = np.diff(np.concatenate([[0], np.searchsorted(hashes, pivots), [len(hashes)]]))
                    have = np.flatnonzero(length)
                    keys.append(np.full(len(have), c[row]))
                    parts.append(have)
                    lengths.append(length[have])
                    tokens.append(hashes)
            if keys:
                ends = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
                yield pa.RecordBatch.from_arrays(
                    [
                        _signed(np.concatenate(keys)),
                        pa.array(np.concatenate(parts), pa.int32()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _signed(np.concatenate(tokens))),
                    ],
                    names=["c", "fragment", "tokens"],
                )

    return rows.select("c", "s1", "s2", "text").mapInArrow(cut, "c long, fragment int, tokens array<long>")


def _perhaps(rows: DataFrame, wanted: DataFrame, on: str) -> DataFrame:
    """The rows that may be among ``wanted`` by the key ``on``: all that are, and few others, before anything is exchanged.

    A Bloom filter of up to 2^BLOOM_BITS bits; with more rows wanted than that, more rows pass in vain, which costs bytes only.
    """
    bits = min(BLOOM_BITS, max(16, (16 * wanted.count()).bit_length()))
    slot = F.xxhash64(on).bitwiseAND((1 << bits) - 1)
    part, place = F.shiftright(slot, 15), slot.bitwiseAND((1 << 15) - 1)
    filled = wanted.select(part.alias("part"), place.alias("place")).groupBy("part").agg(F.bitmap_construct_agg("place").alias("bits"))
    # at most 2^BLOOM_BITS / 2^15 rows of 4 KB
    found = rows.withColumns({"part": part, "place": place}).join(F.broadcast(filled), "part")
    byte = F.conv(F.hex(F.expr("substring(bits, cast(shiftright(place, 3) as int) + 1, 1)")), 16, 10).cast("int")
    there = F.call_function("shiftright", byte, F.col("place").bitwiseAND(7).cast("int")).bitwiseAND(1) == 1
    return found.where(there).select(*rows.columns)


def _verified(
    pairs: DataFrame, classes: DataFrame, texts: DataFrame, size: int, percent: int, fragments: int, scratch: Scratch, name: str
) -> DataFrame:
    """The pairs (a, b) that are similar enough: overlaps counted in each fragment, then summed per pair."""
    wanted = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct()
    wanted = scratch.put(classes.select("c", "h", "s1", "s2").join(wanted.hint("merge"), "c"), f"{name}-wanted")
    # rows that repeat are taken once
    rows = _perhaps(texts, wanted, "h").groupBy("h").agg(F.first("text").alias("text")).join(wanted.hint("merge"), "h")
    segments = scratch.put(_segments(rows, size, fragments), f"{name}-segments")
    cut = pairs.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(fragments - 1))))
    left = segments.select(F.col("c").alias("a"), "fragment", F.col("tokens").alias("x"))
    right = segments.select(F.col("c").alias("b"), "fragment", F.col("tokens").alias("y"))
    partial = (
        cut.join(left.hint("merge"), ["a", "fragment"])
        .join(right.hint("merge"), ["b", "fragment"])
        .select("a", "b", F.size(F.array_intersect("x", "y")).alias("shared"))
    )
    total = partial.groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    na, nb = (classes.select(F.col("c").alias(k), F.col("n").alias(f"n{k}")) for k in "ab")
    similar = F.col("shared") * 100 >= (F.col("na") + F.col("nb") - F.col("shared")) * percent
    links = scratch.put(total.join(na, "a").join(nb, "b").where(similar).select("a", "b"), f"{name}-links")
    scratch.drop(f"{name}-wanted", f"{name}-segments")
    return links


def _least(percent: int):
    """The shingles that x and y must share."""
    return (F.col("x.n") + F.col("y.n")) * percent / (100 + percent)


def _fit(percent: int):
    """Condition on the rows x and y of a posting list: sizes and what can be shared at most leave the pair possible.

    It holds for every similar pair in the first shingle that their prefixes share; later ones may reject it. ``room``
    bounds both sides there. ``left`` bounds the side whose prefix ends first: what it shares up to that end is in the
    other prefix too. The other side may share shingles of its prefix that stand beyond that end and that nobody else's
    prefix has.
    """
    sizes = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent
    first = F.when(F.col("x.last") < F.col("y.last"), F.col("x.left")).when(F.col("x.last") > F.col("y.last"), F.col("y.left"))
    left = F.coalesce(first, F.greatest("x.left", "y.left"))
    return (F.least("x.room", "y.room") >= _least(percent)) & (left >= _least(percent)) & sizes


def jaccard_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 75, hot: int = HOT, fragments: int = 4
) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of at least ``percent`` / 100 of their word shingles.

    Returns one row for each row of ``docs``: (``key``, n_shingles, component_id), where component_id is the smallest
    key reachable by links. Words are runs of bytes other than space and TAB..CR, with A-Z lowered; a text of fewer than
    ``size`` words is one shingle.

    Defined cases: a null or wordless text has 0 shingles, links with nothing and is its own component; a row with a
    null key links as any other, and its component_id is the smallest key that is not null, or null; repeated rows come
    back as often as they came; a key on several texts is one vertex for each text; equal texts are one set, so ties make
    no difference; texts of any length are taken whole; an empty table gives an empty result; other columns of ``docs``
    are not looked at.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    hashed = texts.select("text", _row_hash("id", "text"))
    found = (
        _frequent(texts, "text", size).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "token").limit(FREQUENT).toPandas()
    )
    frequent = found["token"].to_numpy("int64").view(np.uint64)[::-1].copy()

    full = scratch.put(_prefixes(texts, "id", "text", size, percent, frequent), "sets")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h"))
    classes = scratch.put(
        full.where("n > 0")
        .groupBy("s1", "s2", "n")
        .agg(first.alias("first"), F.first("prefix").alias("prefix"), F.first("last").alias("last"))  # equal sets have equal prefixes
        .select("s1", "s2", "n", "first.*", "prefix", "last")
        .withColumn("c", F.monotonically_increasing_id()),
        "classes",
    )
    sets = scratch.put(full.select("id", "n", "s1", "s2"), "members")
    scratch.drop("sets")

    # Keep the prefix shingles that a second class has there too.
    tokens = classes.select("c", F.posexplode("prefix").alias("at", "token"))
    of = classes.select("c", "n", F.size("prefix").alias("p"), "last")
    shared = scratch.put(_repeated(tokens), "shared").withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("token")))
    # room: what a class can share at most with one that it first meets in this shingle; its shingles before it are out.
    # left: the same if the other's prefix ends later. Then the shingles of the prefix that no other prefix has are out too.
    of_class = Window.partitionBy("c")
    left = F.col("n") - F.col("p") + F.count(F.lit(1)).over(of_class) - F.row_number().over(of_class.orderBy("at")) + 1
    postings = shared.join(of.hint("merge"), "c").withColumns({"left": left, "room": F.col("n") - F.col("at")}).drop("at")
    postings = scratch.put(postings, "postings")
    scratch.drop("shared")
    busy = postings.where(F.col("m") > hot)

    cool = postings.where(F.col("m") <= hot)
    pairs = (
        cool.alias("x").join(cool.alias("y").hint("merge"), F.expr("x.token = y.token and x.c < y.c") & _fit(percent))
        .select(F.col("x.c").alias("a"), F.col("y.c").alias("b"))
    )
    centre = busy.groupBy("token").agg(F.min(F.struct(1 - F.col("left") / F.col("n"), "c", "n", "left", "room", "last")).alias("x"))
    centre = centre.select("token", *(F.col(f"x.{k}").alias(k) for k in ("c", "n", "left", "room", "last")))
    to_centre = (
        busy.alias("y").join(centre.alias("x").hint("merge"), F.expr("x.token = y.token and x.c <> y.c") & _fit(percent))
        .select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b"))
    )
    pairs = scratch.put(pairs.union(to_centre).distinct(), "pairs")
    links = _verified(pairs, classes, hashed, size, percent, fragments, scratch, "first")

    if not busy.isEmpty():
        # What the centres left apart: members outside a list's main component against all members of other components.
        # A pair is made in the first list that it shares, and only if the prefixes share enough: beyond them, no more
        # can be shared than the longer remainder.
        part = connected_components(links).withColumnsRenamed({"id": "c", "component": "part"})
        member = busy.join(part.hint("merge"), "c", "left").withColumn("part", F.coalesce("part", F.col("c")))
        main = member.groupBy("token", "part").agg(F.count(F.lit(1)).alias("k"))
        main = main.groupBy("token").agg(F.max_by("part", F.struct("k", "part")).alias("main"))
        member = scratch.put(member.join(main.hint("merge"), "token").withColumn("outside", F.expr("part <> main")).drop("main"), "hot-members")
        # Lists without outsiders are done. Of the others, a list's outsiders are dealt over blocks, and every block meets
        # the whole list; prefixes are asked for here alone.
        some = member.where("outside").select("token").distinct()
        member = member.join(some.hint("merge"), "token")
        theirs = scratch.put(member.select("c").distinct(), "hot-classes")
        heads = scratch.put(_perhaps(classes.select("c", "prefix"), theirs, "c").join(theirs.hint("merge"), "c"), "heads")
        member = scratch.put(member.join(heads.hint("merge"), "c"), "hot-heads")
        blocks = F.ceil(F.col("m") / BLOCK).cast("int")
        outside = member.where("outside").withColumn("block", F.pmod(F.hash("c"), blocks))
        whole = member.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        apart = F.expr("x.token = y.token and x.block = y.block and x.part <> y.part and (not y.outside or x.c < y.c)")
        common = F.array_intersect("x.prefix", "y.prefix")
        enough = F.size(common) + F.greatest(F.col("x.n") - F.col("x.p"), F.col("y.n") - F.col("y.p")) >= _least(percent)
        rest = (
            outside.alias("x").join(whole.alias("y").hint("merge"), apart & _fit(percent) & enough)
            .select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b"))
            .distinct()
        )
        rest = scratch.put(rest.join(pairs.hint("merge"), ["a", "b"], "left_anti"), "rest")
        if not rest.isEmpty():
            links = links.union(_verified(rest, classes, hashed, size, percent, fragments, scratch, "rest"))
        scratch.drop("hot-members", "hot-heads", "hot-classes", "heads")

    # A class's vertex begins with its key, so the smallest vertex of a component names the component.
    vertex = classes.select("c", F.struct("none", "id", "c").alias("vertex"))
    ends = links
    for end in "ab":
        ends = ends.join(vertex.select(F.col("c").alias(end), F.col("vertex").alias(f"v{end}")).hint("merge"), end)
    groups = connected_components(ends, "va", "vb").select(F.col("id.c").alias("c"), F.col("component.id").alias("component_id"), F.lit(True).alias("linked"))
    named = classes.select("c", "id", "s1", "s2", "n").join(groups.hint("merge"), "c", "left")
    named = named.select("s1", "s2", "n", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    worded = sets.where("n > 0").join(named.hint("merge"), ["s1", "s2", "n"])
    out = scratch.put(
        worded.select("id", "n", "component_id").union(sets.where("n = 0").select("id", "n", F.col("id").alias("component_id"))), "groups"
    )
    scratch.drop("members", "classes", "postings", "pairs", "rest", "first-links", "rest-links")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS sh FROM d),
t AS (SELECT doc_id, unnest(sh) AS g FROM s),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM t x JOIN t y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 75 * (len(x.sh) + len(y.sh) - n)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS root FROM s UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id)
SELECT doc_id, CAST(any_value(len(sh)) AS BIGINT) AS n_shingles, min(root) AS component_id FROM s JOIN r ON id = doc_id GROUP BY doc_id
"""
