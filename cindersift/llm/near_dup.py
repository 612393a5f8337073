"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A sketch of a text is made of the few k-mers of words with the least hash values, written in the order in
which they stand in the text. K-mers that occur repeatedly are labelled with the number of their
occurrence. Unlike a set sketch it tells texts apart whose parts were moved, and so follows edit
similarity. Texts with an equal sketch are candidates; a banded alignment of their words decides.

The number of sketches follows from the threshold: of two texts with edit similarity s, changed in scattered
places, about J = s^5 / (2 - s^5) of the k-mers agree, and one sketch of two k-mers agrees with J^2. At the
threshold of 0.85 that is 0.081, and one of 28 sketches agrees with a probability of 0.906; at 0.9 with 0.995.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MOST_SENT, listed, spread, with_ids, written
from .graph import components
from .tokens import MIX, WORD, WordHashes, mixed, runs

#: Words in a k-mer.
SHINGLE = 5
#: K-mers in a sketch, and sketches of a text.
PICKED, SKETCHES = 2, 28
#: Texts of at most so many words, of which one changed word takes a large part of the k-mers, have further sketches of short k-mers.
SHORT, SHORT_SHINGLE, SHORT_SKETCHES = 60, 2, 8
#: Least edit similarity of words, 1 - distance / longer length.
SIMILAR = 0.85
#: Members of groups up to this size are paired by a join, those of larger ones in blocks; both find the same pairs.
PAIRED = 16
#: Members of a block; larger groups are parted by rare k-mers first, which loses no alike pair.
BLOCK = 2048
#: Words in the k-mers of which two alike members of such a group share a rare one.
FINE = 3
#: Counters of a text's words by hash; a bound of the distance that needs no text. Members of large groups have more of them.
BAG, WIDE = 128, 1024
#: Words that are sketched at once.
CHUNK = 200_000


def labelled(grams: np.ndarray, of_text: np.ndarray) -> np.ndarray:
    """``grams`` with repeats inside a text told apart: the second and later occurrences of a value get other values."""
    own = mixed(grams ^ mixed(of_text.astype(np.uint64), 5), 6)
    order = np.argsort(own, kind="stable")
    ranked = own[order]
    first = np.ones(len(grams), bool)
    first[1:] = ranked[1:] != ranked[:-1]
    if first.all():
        return grams
    at = np.arange(len(grams))
    seen = at - np.maximum.accumulate(np.where(first, at, 0))
    again = order[seen > 0]
    out = grams.copy()
    out[again] = mixed(grams[again] + seen[seen > 0].astype(np.uint64) * MIX, 7)
    return out


def kmers(hashes: np.ndarray, sizes: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Labelled k-mers of texts that lie end to end in ``hashes``, ``sizes`` words each, and the text of each.

    A text with fewer words than a k-mer has one k-mer, its words followed by zeros. Every text has a word.
    """
    room = np.maximum(sizes, size)
    if (room > sizes).any():
        wide = np.zeros(int(room.sum()), np.uint64)
        at = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(np.cumsum(room) - room, sizes)
        wide[at] = hashes
        hashes = wide
    of_text = np.repeat(np.arange(len(sizes)), room)
    grams = runs(hashes, size)
    inside = of_text[: len(grams)] == of_text[size - 1 :]
    of_text = of_text[: len(grams)][inside]
    return labelled(grams[inside], of_text), of_text


def picks(grams: np.ndarray, of_text: np.ndarray, n_texts: int, picked: int = PICKED, n: int = SKETCHES) -> np.ndarray:
    """Places in ``grams`` of the least k-mers of each text, in order of the text: n x texts x picked.

    A text with fewer k-mers than ``picked`` repeats the one it has. Every text has a k-mer. The places ride in
    the low bits of the hash values, so that the least value tells where it stands.
    """
    starts = np.searchsorted(of_text, np.arange(n_texts))
    bits = np.uint64(max(24, int(len(grams)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    place = np.arange(len(grams), dtype=np.uint64)
    out = np.empty((n, n_texts, picked), np.int64)
    odd = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64), 17) | np.uint64(1)
    for i in range(n):
        values = (((grams ^ odd[2 * i]) * odd[2 * i + 1]) & ~low) | place
        for k in range(picked):
            out[i, :, k] = (np.minimum.reduceat(values, starts) & low).astype(np.int64)
            values[out[i, :, k]] |= ~low
    out.sort(axis=2)
    return out


def sketched_keys(grams: np.ndarray, chosen: np.ndarray, family: int = 0) -> np.ndarray:
    """One key for each sketch of each text, texts x sketches."""
    n, texts, picked = chosen.shape
    keys = np.repeat(np.arange(n, dtype=np.uint64)[:, None] + np.uint64(1000 * family), texts, axis=1)
    for k in range(picked):
        keys = mixed(keys ^ grams[chosen[:, :, k]], 3)
    return keys.T.view(np.int64)


def sketches(hashes: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The keys of the sketches of each text, from the hashes of its words; short texts have more of them."""
    grams, of_text = kmers(hashes, sizes)
    out = list(sketched_keys(grams, picks(grams, of_text, len(sizes))))
    short = np.flatnonzero(sizes <= SHORT)
    if len(short):
        few = np.isin(np.repeat(np.arange(len(sizes)), sizes), short)
        grams, of_text = kmers(hashes[few], sizes[short], SHORT_SHINGLE)
        more = sketched_keys(grams, picks(grams, of_text, len(short), n=SHORT_SKETCHES), 1)
        for i, own in zip(short, more, strict=True):
            out[i] = np.concatenate([out[i], own])
    return out


def banded(a: list[int], b: list[int], w: int) -> int:
    """Edit distance of two word sequences by paths within ``w`` diagonals of the main one, the bits of a band at once.

    Bit r of a column j stands for the row j - w + r. ``down`` and ``up`` hold where the distance grows and
    falls by one from a row to the next; the place of the band moves on by a row with each column. The result
    is exact if it is at most ``w``, else an upper bound.
    """
    if len(a) < len(b):
        a, b = b, a
    n, m = len(b), len(a)
    if m - n > w:
        return m
    full, top = (1 << (2 * w + 1)) - 1, 1 << (2 * w)
    rows: dict[int, tuple[int, int]] = {}
    for i, word in enumerate(a[:w]):
        bits, _ = rows.get(word, (0, 0))
        rows[word] = (bits | (1 << (w + 1 + i)), 0)
    down, up, distance = full ^ ((1 << w) - 1), 0, 0
    for j, word in enumerate(b, 1):
        if j + w <= m:
            enters = a[j + w - 1]
            bits, last = rows.get(enters, (0, j))
            rows[enters] = ((bits >> (j - last)) | top, j)
        bits, last = rows.get(word, (0, j))
        equal = bits >> (j - last)
        same = ((((equal & down) + down) ^ down) | equal | up) & full
        right, left = (up | ~(same | down)) & full, same & down
        distance += 1 - ((same >> w) & 1)
        down, up = (left | ~((same >> 1) | right)) & full, (same >> 1) & right
    rest = (1 << (m - n)) - 1
    return distance + ((down >> w) & rest).bit_count() - ((up >> w) & rest).bit_count()


def _spare(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements the one has beyond the other as bags, the larger of both ways."""
    _, which = np.unique(np.concatenate([a, b]), return_inverse=True)
    spare = np.bincount(which[: len(a)], minlength=which.max() + 1) - np.bincount(which[len(a) :], minlength=which.max() + 1)
    return int(max(spare[spare > 0].sum(), -spare[spare < 0].sum()))


def alike(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> bool:
    """Whether two word sequences have an edit similarity of at least ``least``.

    Equal ends are cut off; an edit adds at most one word, and at most five 5-word runs, to what one side has
    beyond the other, which rules most unlike pairs out; then bands of growing width, up to the distance that is allowed.
    """
    longer = max(len(a), len(b))
    most = int((1 - least) * longer + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    if len(a) == len(b) and int((a != b).sum()) <= most:
        return True
    k = min(len(a), len(b))
    other = np.flatnonzero(a[:k] != b[:k])
    head = int(other[0]) if len(other) else k
    a, b, k = a[head:], b[head:], k - head
    other = np.flatnonzero(a[len(a) - k :][::-1] != b[len(b) - k :][::-1])
    tail = int(other[0]) if len(other) else k
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if max(len(a), len(b)) <= most:
        return True
    if _spare(a, b) > most or (min(len(a), len(b)) > SHINGLE and _spare(runs(a, SHINGLE), runs(b, SHINGLE)) > SHINGLE * most):
        return False
    one, two, band = a.tolist(), b.tolist(), max(256, abs(len(a) - len(b)))
    while True:
        band = min(band, most)
        if banded(one, two, band) <= min(band, most):
            return True
        if band == most:
            return False
        band *= 8


def _flushed(ids: list[int], names: list[bytes], parts: list[np.ndarray]) -> pd.DataFrame:
    sizes = np.array([len(x) for x in parts], np.int64)
    hashes = np.concatenate(parts)
    cell = np.repeat(np.arange(len(parts)), sizes) * BAG + (hashes % np.uint64(BAG)).astype(np.int64)
    bags = np.minimum(np.bincount(cell, minlength=len(parts) * BAG), 255).astype(np.uint8).reshape(-1, BAG)
    return pd.DataFrame({"doc_id": np.array(ids, np.int64), "content": names, "keys": sketches(hashes, sizes), "bag": [x.tobytes() for x in bags], "n_words": sizes.astype(np.int32)})


def _sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known, ids, names, parts, held = WordHashes(), [], [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            found = WORD.findall(text.lower()) if text else []
            if found:
                ids.append(doc_id)
                names.append(hashlib.md5(" ".join(found).encode("utf-8", "surrogatepass")).digest())
                parts.append(known.of(found))
                held += len(found)
            if held >= CHUNK:
                yield _flushed(ids, names, parts)
                ids, names, parts, held = [], [], [], 0
    if parts:
        yield _flushed(ids, names, parts)


def _near(least: float):
    """Pairs that can be alike: an edit adds at most one word to each side of the difference of two bags."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            one, two = (np.frombuffer(b"".join(batch[c]), np.uint8).reshape(-1, BAG).astype(np.int16) for c in ("bag_a", "bag_b"))
            spare = one - two
            edits = np.maximum(np.maximum(spare, 0).sum(axis=1), np.maximum(-spare, 0).sum(axis=1))
            longer = np.maximum(batch["n_a"], batch["n_b"])
            yield batch.loc[edits <= ((1 - least) * longer + 1e-9).astype(np.int64), ["a", "b"]]

    return run


def _verified(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            held = [alike(known.of(WORD.findall(one.lower())), known.of(WORD.findall(two.lower())), least) for one, two in zip(batch["text_a"], batch["text_b"], strict=True)]
            yield batch.loc[held, ["a", "b"]] if len(batch) else batch[["a", "b"]]

    return run


def _widened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = WordHashes()
    for batch in batches:
        parts = [known.of(WORD.findall(text.lower())) for text in batch["text"]]
        bags = [np.minimum(np.bincount((x % np.uint64(WIDE)).astype(np.int64), minlength=WIDE), 255).astype(np.uint8).tobytes() for x in parts]
        yield pd.DataFrame({"node": batch["doc_id"], "wide": bags, "n_words": np.array([len(x) for x in parts], np.int32)})


def _bounded(least: float):
    """Pairs of a block that can be alike and are of different classes; of a block of two parts, those across them.

    Rows lie in order of length, so that each meets only those that are not too long for it; a coarse bag is
    compared first, then the wide one of what is left. Of the groups that two nodes share the least key tells them.
    """

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("n_words", kind="stable")
        wide = np.frombuffer(b"".join(block["wide"]), np.uint8).reshape(-1, WIDE).astype(np.int16)
        few = wide.reshape(len(wide), -1, BAG).sum(axis=1, dtype=np.int16)
        node, label, part, n = (block[c].to_numpy() for c in ("node", "label", "part", "n_words"))
        key, keys = block["key"].iat[0], [set(x) for x in block["keys"]]
        whole = block["low"].iat[0] == block["high"].iat[0]
        most = ((1 - least) * n + 1e-9).astype(np.int64)
        reach = np.searchsorted(n - most, n, side="right")
        one, two = [], []
        for i in range(len(n)):
            near = i + 1 + np.flatnonzero((label[i + 1 : reach[i]] != label[i]) & (whole | (part[i + 1 : reach[i]] != part[i])))
            for bags in (few, wide):
                spare = bags[near] - bags[i]
                more = np.maximum(spare, 0).sum(axis=1)
                near = near[np.maximum(more, more - spare.sum(axis=1)) <= most[near]]
            near = np.array([j for j in near if min(keys[i] & keys[j]) == key], np.int64)
            one.append(np.full(len(near), node[i]))
            two.append(node[near])
        one, two = np.concatenate(one), np.concatenate(two)
        return pd.DataFrame({"a": np.maximum(one, two), "b": np.minimum(one, two)})

    return run


def _told(least: float):
    """All k-mers of texts, and how many of the rarest of them two alike texts have one in common of.

    An edit takes at most ``FINE`` k-mers from a text. Of two alike texts the longer one has at most its share of
    edits, and so the rarest ``FINE`` for each edit and ``FINE`` more of each hold a common one, whatever is rare.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            grams, most = [], []
            for text in batch["text"]:
                hashes = known.of(WORD.findall(text.lower()))
                grams.append(kmers(hashes, np.array([len(hashes)]), FINE)[0].view(np.int64))
                most.append(FINE * (int((1 - least) * len(hashes) + 1e-9) + 1))
            yield pd.DataFrame({"node": batch["doc_id"], "most": most, "grams": grams})

    return run


def _groups(nodes: DataFrame) -> DataFrame:
    return nodes.select("node", F.explode("keys").alias("key"))


def _met(groups: DataFrame) -> DataFrame:
    """The members of groups of two or more, with the first, the last and the number of the group; of groups with the same members one."""
    group = Window.partitionBy("key")
    members = {"lo": F.min("node"), "hi": F.max("node"), "size": F.count(F.lit(1)), "all": F.bit_xor(F.xxhash64("node"))}
    met = groups.select("key", "node", *[what.over(group).alias(name) for name, what in members.items()]).where("lo < hi")
    same = met.withColumn("first", F.min("key").over(Window.partitionBy(*members)))
    return written(same.where("key = first").select("key", "node", "lo", "hi", "size"))


def _pairs(df: DataFrame, other) -> DataFrame:
    return df.select(F.col("node").alias("a"), other.alias("b")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _labels(found: DataFrame) -> DataFrame:
    """For the larger ends of links a name of their class: the least node they are linked to, or what that is linked to."""
    own = listed(found.groupBy("a").agg(F.min("b").alias("b")))
    return listed(own.join(own.select(F.col("a").alias("b"), F.col("b").alias("c")), "b", "left").select(F.col("a").alias("node"), F.coalesce("c", "b").alias("label")))


def _with_label(df: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """``df`` with the class name of the node in ``name`` as ``of_<name>``."""
    return df.join(labels.select(F.col("node").alias(name), F.col("label").alias("named")), name, "left").withColumn(f"of_{name}", F.coalesce("named", name)).drop("named")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs that are not in one class already."""
    return _with_label(_with_label(pairs, labels, "b"), labels, "a").where("of_a <> of_b").select("a", "b")


def _texts(d: DataFrame, ids: DataFrame) -> DataFrame:
    return with_ids(d.where("text IS NOT NULL"), ids, "doc_id").dropDuplicates(["doc_id"])


def _compared(links: DataFrame, bags: DataFrame | None, d: DataFrame, least: float) -> DataFrame:
    """The links that are alike, by ``bags`` first if they are given. The larger end, which differs from link to link,
    is joined last, so that the many links of one head are compared in many tasks. Both ends read one shuffle of the texts."""
    if bags is not None:
        side = lambda c: bags.select(F.col("node").alias(c), F.col("bag").alias(f"bag_{c}"), F.col("n_words").alias(f"n_{c}"))
        links = written(spread(links.join(side("b"), "b").join(side("a"), "a")).mapInPandas(_near(least), "a long, b long"))
    texts = _texts(d, links.select(F.col("a").alias("doc_id")).unionByName(links.select(F.col("b").alias("doc_id"))))
    first = links.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    # A shuffle by ``a`` rather than a broadcast: alignment, not the bytes moved, is what the tasks share.
    pairs = first.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a").select("a", "b", "text_a", "text_b")
    return written(spread(pairs).mapInPandas(_verified(least), "a long, b long"))


def _rare(members: DataFrame, d: DataFrame, least: float) -> DataFrame:
    """Groups of the nodes ``members`` by their rarest k-mers, ``(key, node)``; two that are alike are in one of them."""
    told = written(_texts(d, members).mapInPandas(_told(least), "node long, most int, grams array<long>"))
    each = told.select("node", "most", F.size("grams").alias("n"), F.explode("grams").alias("key"))
    often = each.withColumn("often", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("often > 1")
    own = Window.partitionBy("node")
    met = often.withColumn("alone", F.col("n") - F.count(F.lit(1)).over(own)).withColumn("nth", F.row_number().over(own.orderBy("often", "key")))
    return written(met.where("alone + nth <= most").select("node", "key"))


def _crossed(met: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of members of one group that are not in one class yet; of each, one is not in the class of the group's first member."""
    named = written(_with_label(_with_label(met, labels, "lo"), labels, "node").select("key", "node", "of_node", "of_lo"))
    odd = named.where("of_node <> of_lo").select("key", "node", "of_node")
    others = named.select("key", F.col("node").alias("other"), F.col("of_node").alias("of_other"))
    return _pairs(odd.join(others, "key").where("of_node <> of_other"), F.col("other"))


def _mixed(met: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of groups that have members of several classes, with their class."""
    named = written(_with_label(_with_label(met, labels, "lo"), labels, "node").select("key", "node", "size", F.col("of_node").alias("label"), "of_lo"))
    return written(named.join(named.where("label <> of_lo").select("key").distinct(), "key", "left_semi").select("key", "node", "size", "label"))


def _blocked(mixed_: DataFrame, d: DataFrame, least: float) -> DataFrame:
    """Pairs of members of one group that are not in one class and can be alike by their bags.

    A group above ``BLOCK`` is dealt to parts, and each two parts are a block; a task holds two parts at most.
    """
    wide = _texts(d, mixed_.select(F.col("node").alias("doc_id"))).mapInPandas(_widened, "node long, wide binary, n_words int")
    wide = written(wide.join(mixed_.groupBy("node").agg(F.collect_set("key").alias("keys")), "node"))
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = mixed_.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = dealt.select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "node", "label", "part").join(wide, "node")
    return rows.groupBy("key", "low", "high").applyInPandas(_bounded(least), "a long, b long")


def _searched(nodes: DataFrame, d: DataFrame, least: float) -> DataFrame:
    """Verified links ``(a, b)`` that hold the classes of ``nodes`` together.

    The classes are those of all pairs that share a sketch and are alike, whatever the size of the table or of a
    group. Each node is compared with the least of the first members of its groups, then with the first and the
    last of all its groups, and the shortest of the large ones, that are not of its class yet. Where a group still
    has members of several classes, all its pairs of different classes are compared: in a group above ``PAIRED``
    by their bags in the tasks that hold a block, so that only pairs that can be alike become rows. A group above
    ``BLOCK`` is parted first: all alike members share one of their rarest k-mers.
    """
    bags, keys = nodes.select("node", "bag", "n_words"), nodes.select("node", "keys")
    tried = found = None

    def compare(links: DataFrame, shared: bool = True, bounded: bool = False) -> None:
        nonlocal tried, found
        links = listed(links if tried is None else links.join(tried, ["a", "b"], "left_anti"))
        if tried is not None and links.isEmpty():
            return
        # What comes from blocks was compared by bags there.
        held = _compared(links, None if bounded else bags, d, least)
        if not shared:
            side = lambda c: keys.select(F.col("node").alias(c), F.col("keys").alias(f"keys_{c}"))
            held = listed(held.join(side("a"), "a").join(side("b"), "b").where(F.arrays_overlap("keys_a", "keys_b")).select("a", "b"))
        tried, found = (links, held) if tried is None else (tried.unionByName(links), found.unionByName(held))

    def searched(met: DataFrame, shared: bool = True) -> DataFrame:
        """Compares the members of groups with heads and those of groups up to ``PAIRED`` with each other; the larger mixed groups are left."""
        first = met.where("node <> lo").groupBy(F.col("node").alias("a")).agg(F.min("lo").alias("b"))
        compare(first if found is None else _apart(first, _labels(found)), shared)
        large = met.where(F.col("size") > PAIRED)
        shortest = large.join(nodes.select("node", "n_words"), "node").select("node", F.min(F.struct("n_words", "node")).over(Window.partitionBy("key"))["node"].alias("head"))
        heads = met.select("node", F.explode(F.array("lo", "hi")).alias("head")).unionByName(shortest)
        compare(_apart(_pairs(heads, F.col("head")), _labels(found)), shared)
        compare(_crossed(met.where((F.col("size") > 3) & (F.col("size") <= PAIRED)), _labels(found)), shared)
        return _mixed(large, components(found))

    left = searched(_met(_groups(nodes)))
    compare(_blocked(left.where(F.col("size") <= BLOCK), d, least), bounded=True)
    members = written(left.where(F.col("size") > BLOCK).select(F.col("node").alias("doc_id")).distinct())
    if not members.isEmpty():
        compare(_blocked(searched(_met(_rare(members, d, least)), False), d, least), False, True)
    return found


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = SIMILAR) -> DataFrame:
    """``(doc_id, class_id)`` for each document of ``docs`` with an id; the class id is its smallest document id.

    Copies, texts with the same words but for case and white space, are one node of the graph; nodes of one
    sketch are linked to the first and the last of them, those of other classes by ``_searched``, and each distinct
    link is verified once. Whole texts are compared, also very long ones: a pair costs its length times the
    width of the band over the bits of a machine word. Texts that are null or have no word are classes of their own. A document is known by its
    id: rows that repeat an id should agree, and give one result row. Rows without an id are left out. Integer ids only.
    """
    d = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketched = written(d.mapInPandas(_sketched, "doc_id long, content binary, keys array<long>, bag binary, n_words int"))
    nodes = written(sketched.groupBy("content").agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys"), F.first("bag").alias("bag"), F.first("n_words").alias("n_words")))
    found = components(_searched(nodes, d, least))
    named = nodes.join(found, "node", "left").select("content", F.coalesce("label", "node").alias("class_id"))
    held = sketched.select("doc_id", "content").join(named, "content").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    return d.select("doc_id").distinct().join(held, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the document with the smallest id, once; and rows without an id."""
    decided = written(classes(docs, id_col, **options))
    gone = decided.where("doc_id <> class_id").select(F.col("doc_id").alias(id_col))
    few = gone.limit(MOST_SENT + 1).count() <= MOST_SENT
    # The ids that go are sent to the texts where they are few, as a shuffle would move all texts.
    stay = docs.join(F.broadcast(gone) if few else gone, id_col, "left_anti").select(*docs.columns)
    again = written(docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col))
    if again.isEmpty():
        return stay
    return stay.join(again, id_col, "left_anti").select(*docs.columns).unionByName(stay.join(again, id_col, "left_semi").dropDuplicates([id_col]).select(*docs.columns))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: id, class id, and whether it is the one of its class that stays."""
    return classes(docs).withColumn("kept", F.col("doc_id") == F.col("class_id"))
