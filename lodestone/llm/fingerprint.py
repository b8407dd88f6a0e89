r"""Document fingerprints: a Merkle tree over paragraphs and sections.

Lines are paragraphs. A paragraph's digest opens a new section after it when its last hex
digit is under 4, so that section borders follow the content and an edit moves no border
elsewhere. A section's digest covers those of its paragraphs, the root those of the
sections: equal texts have equal roots. The fingerprint is the root and the sections'
digests.

The leaves are the pieces of the paragraphs: a line is cut where its own characters say so
(``CUT``: behind the blank after a word that ends in a marked character, behind marks of
wide scripts, and in runs without blanks behind a pattern of marked and other characters),
into pieces of ``LEAST`` to ``PIECE`` characters (a line's last may have fewer). A
paragraph's digest, over the line that its pieces make up, covers them.

near_edited and near_next are the likeness of two trees: 1 where the roots are equal, else
the Dice of their leaves, each as often as it occurs and by its characters. Equal sections
and paragraphs hold equal leaves, so this is what a descent into the differing branches
finds; trees without a common leaf have 0. ``locate_edits`` goes down the differing
branches and says which paragraphs were changed and which moved.

Everything is a DataFrame expression; nothing runs in Python.

Defined results: a null text is an empty one. An empty text has one empty paragraph and no
leaves. Documents of one id (repeated rows) have the same next document; where several
rows have the next id, it is the one whose needed first characters, then fingerprint, are
least. A null id comes last in descending order. One id alone is followed by itself. An
empty table gives no rows. Texts are read whole; only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import cut

#: Hex digits of an inner node: 128 bits.
DIGEST = 32
LEAST, PIECE = 8, 96
#: Of the visible ASCII characters every second is marked, and so is all beyond ASCII.
_MARKED = "".join(f"\\x{c:02X}" for c in range(34, 127, 2))
_OTHER = "".join(f"\\x{c:02X}" for c in range(33, 127, 2))
CUT = rf"(?:(?<=[{_MARKED}\u0080-\uFFFF]\s)|(?<=[\u3001\u3002\uFF01\uFF0C\uFF1A\uFF1B\uFF1F])|(?<=\S{{20}}[{_MARKED}][{_OTHER}][{_MARKED}][{_MARKED}]))"
PIECES = rf"[^\n]{{{LEAST},{PIECE}}}?{CUT}|[^\n]{{{PIECE}}}|[^\n]+"


def _short(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, DIGEST)


def paragraphs(text: Column) -> Column:
    """Digests of the lines."""
    return F.transform(F.split(text, "\n"), _short)


def sections(paras: Column) -> Column:
    """Digests of the runs of paragraphs between borders."""
    marked = F.array_join(F.transform(paras, lambda d: F.when(F.substring(d, -1, 1) < "4", F.concat(d, F.lit("|"))).otherwise(d)), "")
    return F.transform(F.filter(F.split(marked, r"\|"), lambda s: s != ""), _short)


def root(sects: Column) -> Column:
    return F.sha2(F.array_join(sects, ""), 256)


def fingerprint(text: Column) -> Column:
    """The root and the digests of the sections, as one string."""
    sects = sections(paragraphs(text))
    return F.concat_ws(":", root(sects), F.array_join(sects, ""))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _length(piece: Column) -> Column:
    return piece.bitwiseAND(F.lit(127))


def pieces(text: Column) -> Column:
    """Hashes of the pieces of all paragraphs, the n-th of equal ones with its n: all are distinct. The last 7 bits are a piece's length."""
    sized = lambda h, length: h.bitwiseAND(F.lit(-128)).bitwiseOR(length)
    hashes = F.transform(F.regexp_extract_all(text, F.lit(PIECES), F.lit(0)), lambda p: sized(F.xxhash64(p), F.char_length(p).cast("long")))

    def numbered(s: Column) -> Column:
        firsts = F.filter(F.transform(s, lambda h, i: F.when((i == 0) | (h != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        times = lambda at, i, j: F.sequence(F.lit(1), F.coalesce(F.get(at, j + 1), F.size(s)) - i)
        return _let(firsts, lambda at: F.flatten(F.transform(at, lambda i, j: F.transform(times(at, i, j), lambda n: F.when(n == 1, F.get(s, i)).otherwise(sized(F.xxhash64(F.get(s, i), n), _length(F.get(s, i))))))))

    once = lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), hs).otherwise(_let(F.sort_array(hs), numbered))
    return _let(hashes, once)


def likeness(a: Column, a_pieces: Column, b: Column, b_pieces: Column) -> Column:
    """0 to 1 from two fingerprints and their trees' leaves."""
    length = lambda ps: F.aggregate(ps, F.lit(0).cast("long"), lambda n, p: n + _length(p))
    total = length(a_pieces) + length(b_pieces)
    return F.when(a == b, F.lit(1.0)).when(total == 0, F.lit(0.0)).otherwise(2.0 * length(F.array_intersect(a_pieces, b_pieces)) / total)


def tree(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, root, sections, paragraphs, pieces of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    paras = docs.select(F.col(id_col).alias("id"), paragraphs(text).alias("paragraphs"), pieces(text).alias("pieces"))
    with_sections = paras.withColumn("sections", sections(F.col("paragraphs")))
    return with_sections.select("id", root(F.col("sections")).alias("root"), "sections", "paragraphs", "pieces")


def _differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, side, pos, kind) of the nodes (id, pos, digest) that the other side lacks, or has at another place among the common ones.

    The n-th of equal digests on one side goes with the n-th on the other.
    """

    def numbered(rows: DataFrame, side: str) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy("id", "digest").orderBy("pos"))
        return rows.select(F.struct("id").alias(f"{side}_id"), F.col("digest").alias(f"{side}_d"), nth.alias(f"{side}_n"), F.col("pos").alias(side))

    same = (F.col("left_id") == F.col("right_id")) & (F.col("left_d") == F.col("right_d")) & (F.col("left_n") == F.col("right_n"))
    both = numbered(left, "left").join(numbered(right, "right"), same, "full").withColumn("of", F.coalesce("left_id", "right_id"))
    common = F.col("left").isNotNull() & F.col("right").isNotNull()
    place = lambda side: F.row_number().over(Window.partitionBy("of", common).orderBy(side))
    placed = both.withColumn("moved", common & (place("left") != place("right")))
    sides = [
        placed.where(F.col(side).isNotNull() & (~common | F.col("moved"))).select("of.id", F.lit(side).alias("side"), F.col(side).alias("pos"), F.when(F.col("moved"), "moved").otherwise("changed").alias("kind"))
        for side in ("left", "right")
    ]
    return sides[0].unionAll(sides[1])


def locate_edits(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, side, paragraph, kind) from two versions' trees, as ``tree`` gives them, one row an id.

    Only where roots differ are sections compared, and only paragraphs of differing sections
    then. ``paragraph`` counts from 0 on its side; ``kind`` is changed, or moved where both
    have it at different places among the common ones of the differing sections. An id that
    one side lacks isn't compared.
    """
    roots = [t.select(F.struct("id").alias(f"{x}_key"), F.col("root").alias(f"{x}_root")) for t, x in ((left, "l"), (right, "r"))]
    differ = roots[0].join(roots[1], (F.col("l_key") == F.col("r_key")) & (F.col("l_root") != F.col("r_root"))).select(F.col("l_key").alias("key"))
    both = [t.join(differ, F.struct("id") == F.col("key"), "left_semi") for t in (left, right)]
    sects = [t.select("id", F.posexplode("sections").alias("pos", "digest")) for t in both]
    open_ = _differing(*sects).select(F.struct("id").alias("key"), "side", F.col("pos").alias("sect")).distinct()
    before = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    border = (F.substring("digest", -1, 1) < "4").cast("long")
    paras = []
    for t, side in zip(both, ("left", "right"), strict=True):
        rows = t.select("id", F.posexplode("paragraphs").alias("pos", "digest")).withColumn("in", F.coalesce(F.sum(border).over(before), F.lit(0)))
        paras.append(rows.join(open_.where(F.col("side") == side), (F.struct("id") == F.col("key")) & (F.col("in") == F.col("sect")), "left_semi").select("id", "pos", "digest"))
    return _differing(*paras).select("id", "side", F.col("pos").alias("paragraph"), "kind")


def _cycle(ids: DataFrame) -> DataFrame:
    """next_id for every distinct id, descending with null last, the last followed by the first.

    The ids are range-sorted; within a partition the next is the next row, and for a
    partition's last row the first of the next partition, of which there is a row each.
    """
    ordered = cut(ids.repartitionByRange(F.col("id").desc_nulls_last()).sortWithinPartitions(F.col("id").desc_nulls_last()))
    placed = ordered.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    firsts = placed.groupBy("part").agg(F.min_by(F.struct("id"), "at").alias("first"))
    every = Window.orderBy("part")  # a row for each partition
    after = firsts.select(
        F.col("part").alias("p"),
        F.coalesce(F.lead("first").over(every), F.first("first").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"),
    )
    nearest = placed.withColumn("next", F.lead(F.struct("id")).over(Window.partitionBy("part").orderBy("at")))
    joined = nearest.join(F.broadcast(after), F.col("part") == F.col("p"))  # as many rows as partitions
    return joined.select(F.col("id").alias("n_id"), F.coalesce("next", "after")["id"].alias("next_id"), "need")


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last third replaced by the first characters of the next
    document in descending id order.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    third = lambda text: F.floor(F.char_length(text) / 3).cast("int")
    ring = _cycle(plain.groupBy("id").agg(F.max(third(F.col("text"))).alias("need")))
    # what an id needs of its next document goes to it: a third of the text and the leaves.
    # Both sides compute them after the shuffle of the texts, which would carry them else
    text = F.col("text")
    # and all shuffles are by one key (a struct, in which nulls are equal), so that the heads are shuffled once
    keyed = plain.select(F.struct("id").alias("key"), "text")
    heads = (
        keyed.join(ring.withColumn("next_key", F.struct(F.col("next_id").alias("id"))), F.col("key") == F.col("next_key"))
        .select(F.struct(F.col("n_id").alias("id")).alias("n_key"), F.struct(F.expr("left(text, need)").alias("head"), fingerprint(text).alias("fp"), pieces(text).alias("pc")).alias("next"))
        .groupBy("n_key").agg(F.min("next").alias("next"))
    )
    both = keyed.join(heads, F.col("key") == F.col("n_key")).withColumns({"fp": fingerprint(text), "pc": pieces(text)})
    k, n = third(F.col("text")), F.char_length("text")
    edited = both.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(F.col("next.head"), F.lit(1), k)))
    out = edited.withColumn("efp", fingerprint(F.col("edited"))).withColumn("epc", pieces(F.col("edited")))
    return out.select(
        "key.id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.col("fp").alias("fingerprint"), F.col("efp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("pc"), F.col("efp"), F.col("epc")).alias("near_edited"),
        likeness(F.col("fp"), F.col("pc"), F.col("next.fp"), F.col("next.pc")).alias("near_next"),
    )
