"""Operator 1, document fingerprints. DataFrame operations only.

A Merkle tree over a text: paragraphs are its lines, sections are runs of eight
paragraphs, and a paragraph's leaves are digests of short blocks of words. Blocks
end where a word's last letter says so, so they fall in step again right after an
edit. A paragraph's node is the SHA-256 of its leaves, a section's that of its
paragraphs' nodes, the root that of the sections' nodes and the text's length.

A fingerprint is the root followed by a sketch of the tree's leaves. Equal roots
mean equal texts (but for accidents of 64-bit leaves); two sketches tell how like
two texts are, without them; of two trees only branches that differ need be
followed to find the edited paragraphs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECTION = 8
#: Boundaries kept on the driver and in the plan: 2 ** STEPS at most.
STEPS = 17
ROWS_PER_BUCKET = 4_000
#: Rows whose keys are looked at for each boundary, and for all.
SAMPLED, MOST_SAMPLED = 64, 1 << 21
#: Leaves in a sketch, of eight hexadecimal digits each.
SKETCH, DIGITS = 64, 8
#: What unequal texts can't exceed.
ALIKE = 1.0 - 1.0 / 256
#: A block is a run of up to eight words, white space before them included, and ends
#: at a word whose last letter is one of these; of longer words, and of text without
#: spaces, it is up to 24 characters or what a mark of such a script ends.
_WORD = r"\s*+\S{1,24}+(?!\S)"
_ENDS = r"\s*+\S{0,23}[.,;:!?0-9aeghkmps](?!\S)"
_PIECE = r"\s*+[^\s\u3001\u3002\uff01\uff0c\uff1f]{1,24}+[\u3001\u3002\uff01\uff0c\uff1f]*+"
BLOCK = rf"(?:{_WORD}){{0,7}}?{_ENDS}|(?:{_WORD}){{1,8}}+|{_PIECE}|\s++|\S"


def paragraphs(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def leaf_digests(paragraph: Column) -> Column:
    """One 64-bit digest for each block; blocks leave nothing of the paragraph out."""
    return F.transform(F.regexp_extract_all(paragraph, F.lit(BLOCK), F.lit(0)), lambda b: F.xxhash64(b))


def paragraph_node(leaves: Column) -> Column:
    return F.sha2(F.array_join(F.transform(leaves, lambda d: F.hex(d)), ","), 256)


def section_nodes(nodes: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / SECTION).cast("int")), lambda s: F.sha2(F.array_join(F.slice(nodes, s * SECTION + 1, SECTION), ""), 256))


def root(sections: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.octet_length(F.coalesce(text, F.lit(""))).cast("string"), F.array_join(sections, "")), 256)


def sketch(leaves: Column) -> Column:
    """The ``SKETCH`` smallest distinct leaves, cut to 32 bits, in ascending order; all of them if there are fewer."""
    values = F.sort_array(F.array_distinct(F.transform(F.flatten(leaves), lambda d: F.shiftrightunsigned(d, 32))))
    return F.array_join(F.transform(F.slice(values, 1, SKETCH), lambda v: F.lpad(F.lower(F.hex(v)), DIGITS, "0")), "")


def sketched(fingerprint: Column) -> Column:
    return F.regexp_extract_all(F.substring_index(fingerprint, ":", -1), F.lit(f"[0-9a-f]{{{DIGITS}}}"), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """How like two fingerprints are: 1 for equal texts, 0 for texts that share no block, the Dice coefficient of their blocks between.

    Taken from the sketches: of the smallest leaves of both, the share that both
    have estimates the Jaccard similarity. It is exact where both sketches hold all
    leaves, else its standard error is 0.06 at most. Unequal texts stay below 1.
    """
    x, y = sketched(a), sketched(b)
    both = F.sort_array(F.array_union(x, y))
    least = F.when((F.size(x) < SKETCH) & (F.size(y) < SKETCH), both).otherwise(F.slice(both, 1, SKETCH))
    shared = F.size(F.array_intersect(least, F.array_intersect(x, y)))
    dice = 2.0 * shared / F.greatest(F.size(least) + shared, F.lit(1))
    return F.when(a == b, F.lit(1.0)).otherwise(F.least(dice, F.lit(ALIKE)))


def differing(a: Column, b: Column) -> Column:
    """Numbers of the branches in which two arrays of nodes differ, those that only one has included."""
    n = F.greatest(F.size(a), F.size(b))
    return F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i)))


def fingerprint_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint`` (root, a colon, sketch), ``fp_paragraphs`` and ``fp_sections`` (nodes).

    Null texts count as empty; every text has a root, that of the empty text
    included. Rows and other columns stay as they are (columns called so are
    replaced). No shuffle.
    """
    base = docs.drop("fingerprint", "fp_paragraphs", "fp_sections", "fp_leaves")
    leaved = base.select("*", F.transform(paragraphs(F.col(text)), leaf_digests).alias("fp_leaves"))
    noded = leaved.select("*", F.transform("fp_leaves", paragraph_node).alias("fp_paragraphs"))
    sectioned = noded.select("*", section_nodes(F.col("fp_paragraphs")).alias("fp_sections"))
    return sectioned.select("*", F.concat(root(F.col("fp_sections"), F.col(text)), F.lit(":"), sketch(F.col("fp_leaves"))).alias("fingerprint")).drop("fp_leaves")


def edits(a_paragraphs: Column, a_sections: Column, b_paragraphs: Column, b_sections: Column) -> Column:
    """Numbers of differing paragraphs, looked for in differing sections only."""
    return F.flatten(
        F.transform(
            differing(a_sections, b_sections),
            lambda s: F.transform(differing(F.slice(a_paragraphs, s * SECTION + 1, SECTION), F.slice(b_paragraphs, s * SECTION + 1, SECTION)), lambda p: s * SECTION + p),
        )
    )


def _bounds(rows: DataFrame, buckets: int, total: int) -> list[tuple[int, int]]:
    """Ends of buckets in ascending order of ``k, tie``, all of them pairs that occur, the highest of all last."""
    step = max(1, total // min(buckets * SAMPLED, MOST_SAMPLED))
    seen = rows.select("k", "tie").filter(F.pmod(F.xxhash64("k", "tie", F.lit(17)), F.lit(step)) == 0)
    inner = []
    if buckets > 1:  # only the boundaries reach the driver
        pick = F.transform(F.sequence(F.lit(1), F.lit(buckets - 1)), lambda i: F.get("s", F.floor(F.size("s") * i.cast("long") / buckets).cast("int")))
        inner = seen.agg(F.sort_array(F.collect_set(F.struct("k", "tie"))).alias("s")).select(F.array_distinct(pick).alias("b")).first()["b"]
    top = rows.agg(F.max(F.struct("k", "tie")).alias("m")).first()["m"]
    return sorted({*((x["k"], x["tie"]) for x in inner if x is not None), (top["k"], top["tie"])})


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", rows_per_bucket: int = ROWS_PER_BUCKET) -> tuple[DataFrame, Window]:
    """(``id, text, own, next_text`` with the keys of the order, the order): each document with the text of the next one in descending key order, the first after the last.

    Nulls come last; equal keys are ordered by a hash of the text, and equal rows
    follow one another. Texts move once: keys that occur cut the order into
    buckets, a row at the upper end of a bucket goes to the one above as well (with
    ``own`` false), and each bucket is a window of its own. The boundaries, at most
    ``2 ** STEPS`` pairs of numbers, are looked up by binary search in each row.
    Rows that repeat key and text stay in one bucket, which spills if it must.
    """
    k = F.coalesce(docs[key].cast("long"), F.lit(-(2**63)))
    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    rows = docs.select(docs[key].alias("id"), t.alias("text"), k.alias("k"), F.xxhash64(t).alias("tie"))
    order = Window.partitionBy("bucket").orderBy(F.col("own").desc(), F.col("k").desc(), F.col("tie").desc())
    total = docs.count()
    if total == 0:
        return rows.select("*", F.lit(0).alias("bucket"), F.lit(True).alias("own"), F.lit("").alias("next_text")), order
    bounds = _bounds(rows, max(1, min(2**STEPS, -(-total // rows_per_bucket))), total)
    # One text that folds to one literal, however many there are.
    array = lambda n: F.split(F.lit(",".join(str(b[n]) for b in bounds)), ",").cast("array<bigint>")
    ks, ties = array(0), array(1)
    below = lambda i: (F.get(ks, i) < F.col("k")) | ((F.get(ks, i) == F.col("k")) & (F.get(ties, i) < F.col("tie")))
    steps = F.array(*[F.lit(2**i) for i in reversed(range(len(bounds).bit_length()))])
    # Binary search: the number of boundaries below the row.
    lower = F.aggregate(steps, F.lit(0), lambda at, n: F.when(F.coalesce(below(at + n - 1), F.lit(False)), at + n).otherwise(at))
    placed = rows.select("*", lower.alias("b"))
    at_end = (F.get(ks, F.col("b")) == F.col("k")) & (F.get(ties, F.col("b")) == F.col("tie"))
    # The highest row of all goes to the lowest bucket: the first follows the last.
    above = F.when(F.col("b") + 1 < len(bounds), F.col("b") + 1).otherwise(F.lit(0))
    own = F.struct(F.col("b").alias("bucket"), F.lit(True).alias("own"))
    both = placed.select("*", F.explode(F.when(at_end, F.array(own, F.struct(above.alias("bucket"), F.lit(False).alias("own")))).otherwise(F.array(own))).alias("to"))
    dealt = both.select("id", "text", "k", "tie", "to.bucket", "to.own")
    return dealt.select("*", F.lead("text").over(order).alias("next_text")), order


def edited_text(text: Column, following: Column) -> Column:
    """The last ``floor(n / 2)`` code points replaced by the first as many, or all, of ``following``."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Each document's fingerprint with that of its edited text and its likeness to it and to the next document.

    One row for each row in: ``key, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, n_paragraphs,
    n_edited_paragraphs, first_edited_paragraph``. Null texts count as empty; a
    document that is alone follows itself; an empty table gives an empty result.
    """
    pairs, order = with_next(docs, key, text, rows_per_bucket)
    # The next document's fingerprint comes from its own row, in the same window.
    own = fingerprint_documents(pairs).withColumnsRenamed({"fingerprint": "fingerprint_", "fp_paragraphs": "p_", "fp_sections": "s_"})
    followed = own.select("*", F.lead("fingerprint_").over(order).alias("next_")).filter("own")
    # A document alone in its table follows itself.
    whole = followed.select("id", "text", "fingerprint_", "p_", "s_", F.coalesce("next_", "fingerprint_").alias("next_"), edited_text(F.col("text"), F.coalesce("next_text", "text")).alias("edited"))
    other = fingerprint_documents(whole, "edited")
    out = other.select(
        F.col("id").alias(key),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.col("fingerprint_").alias("fingerprint"),
        F.col("fingerprint").alias("edited_fingerprint"),
        likeness(F.col("fingerprint_"), F.col("fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint_"), F.col("next_")).alias("near_next"),
        F.size("p_").cast("long").alias("n_paragraphs"),
        edits(F.col("p_"), F.col("s_"), F.col("fp_paragraphs"), F.col("fp_sections")).alias("edits"),
    )
    return out.select("*", F.size("edits").cast("long").alias("n_edited_paragraphs"), F.get("edits", F.lit(0)).cast("long").alias("first_edited_paragraph")).drop("edits")
