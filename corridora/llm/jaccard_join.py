"""N-gram Jaccard join by a token-group matrix: all links, connected components.

A document's set is its distinct word shingles. Two documents link when their sets' Jaccard
similarity reaches the threshold. The join loses no link and never emits all pairs of a group:

1. *Survivors.* Shingles are dealt out by hash as packed numpy blobs; one that lies in a single
   document cannot be in any intersection, so only shared shingles come back to their documents.
   A shingle of several sets of a block is dealt out once with their number, so one that all documents
   have is a few bytes a block, and its sets wait with their block.
   A set of n shingles with fewer than threshold * n shared ones has no partner and drops out.
   Documents with equal sets form a class and are handled once.
2. *Prefixes.* In the global order (rarest first) linked sets share one of the first
   ``shared - ceil(threshold * n) + 1`` shared shingles; the smaller of two needs fewer, as its
   overlap must reach ``2 * threshold / (1 + threshold)`` of its size.
3. *Leaders.* Every set is compared with the most central set that it meets at a prefix shingle;
   these true links already tie most families of near copies together, one comparison a set.
4. *Token-group matrix.* Linked sets are dealt into groups of bounded size (shingles and members);
   each group stores the union of its shingles. Sets of other clusters that meet a group at a prefix shingle are
   bounded by their overlap with that union, and only qualifying groups are opened and compared.
5. Components are found over the links in rounds that grow with the logarithm of the longest path.

The plan is the same at every size: joins by key without hints, so Spark broadcasts a side only below
its own threshold, and splits a hot key of a join by AQE.

Defined results: null and empty texts and texts without words have no shingles and link with
nothing; equal texts always share a component; rows that repeat are kept, each with its own
result; an empty table gives an empty result; other columns are ignored. A null id takes part in
links but never names a component. The input should be a table or a materialized DataFrame, as
documents are referred to by their place in a task's rows.

Words and shingles are told apart by hashes: sets have 128-bit names; within a compared pair of sets
of a thousand shingles, which are 48-bit values then, the odds that two different ones coincide are
about 1 in 10**8. A set's size is counted on 64-bit shingles.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as kernels
from ..operators.graph import components
from .shared import input_bytes, materialize, partitions, release

TOKEN_BITS = 48
#: A block of documents that is packed together: at most so many shingles and rows.
FLUSH_TOKENS, FLUSH_ROWS = 500_000, 60_000
#: From so many sets of a block on, a shingle's sets stay with their block, and only their number is compared.
HOME_SETS = 4
#: Shared shingles and members of a group of the token-group matrix, on average at most (or one set).
GROUP_TOKENS, GROUP_MEMBERS = 25_000, 64
#: Bytes of text whose shingles one task compares.
PART_BYTES = 64 << 20

_PACKED = "part int, flush long, n int, ids binary, tokens binary, owners binary, weights binary"
_SETS = "doc_id long, text_hash long, row long, n_shingles long, name long, other_name long, central double, prefix int, tokens array<long>"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_PACKED_ARROW = pa.schema([("part", pa.int32()), ("flush", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("tokens", pa.binary()), ("owners", pa.binary()), ("weights", pa.binary())])


#: Kinds of rows beside tables (their number of documents), shingles with their sets (minus the bytes of a
#: step) and shared ones (-1): sets that wait with their block, numbers of sets, and weights for the former.
_HOME, _COUNTED, _WEIGHED = -16, -17, -18
_NULL_ID = np.int64(-(2**63))


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids as longs, and which of them are null."""
    gone = np.asarray(column.is_null().to_numpy(zero_copy_only=False), dtype=bool)
    return np.asarray(column.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64), gone


def _packer(words: int, parts: int):
    """Documents to blobs: a table of documents and sets, and shingles by hash range."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        flush = TaskContext.get().partitionId() << 24
        held: list[tuple] = []
        tokens = sets = 0

        def out() -> pa.RecordBatch:
            ids, gone, said, counts, names, others, hashes = (np.concatenate(x) for x in zip(*held, strict=True))
            owners = np.repeat(np.arange(len(counts)), counts)
            some = np.flatnonzero(counts)
            order = some[np.lexsort((some, others[some], names[some]))]
            new = np.ones(len(order), dtype=bool)
            new[1:] = (names[order][1:] != names[order][:-1]) | (others[order][1:] != others[order][:-1])
            first = order[new]
            number = np.full(len(counts), -1)
            number[first] = np.arange(len(first))
            own = number[owners]
            keep = own >= 0
            value, own = hashes[keep] >> np.uint64(64 - TOKEN_BITS), own[keep].astype(np.uint16)
            order = np.argsort(value, kind="stable")
            value, own = value[order], own[order]
            sets_at = np.full(len(counts), 65535, dtype=np.uint16)
            sets_at[first] = number[first]
            rows = [(flush % parts, flush, len(counts), kernels.squeeze(np.concatenate([np.where(gone, _NULL_ID, ids), said])), kernels.squeeze(np.concatenate([names, others])), kernels.squeeze(counts.astype(np.int32)), kernels.squeeze(sets_at))]
            starts = np.flatnonzero(np.r_[True, value[1:] != value[:-1]]) if len(value) else np.zeros(0, np.int64)
            many = np.diff(np.r_[starts, len(value)])
            home = many >= HOME_SETS
            bounds = (np.arange(parts + 1, dtype=object) * 2**TOKEN_BITS // parts).astype(np.uint64)
            if home.any():
                stays, here, sets_of = np.repeat(home, many), value[starts[home]], many[home].astype(np.uint32)
                rows.append((flush % parts, flush, _HOME, None, kernels.squeeze(here), kernels.squeeze(own[stays]), kernels.squeeze(sets_of)))
                value, own = value[~stays], own[~stays]
                edges = np.searchsorted(here, bounds)
                for r in np.flatnonzero(np.diff(edges)):
                    rows.append((int(r), flush, _COUNTED, None, kernels.squeeze(here[edges[r] : edges[r + 1]]), None, kernels.squeeze(sets_of[edges[r] : edges[r + 1]])))
            edges = np.searchsorted(value, bounds)
            for r in np.flatnonzero(np.diff(edges)):
                x = value[edges[r] : edges[r + 1]]
                step = np.diff(x, prepend=np.uint64(0))
                step = step.astype(np.uint32) if step[1:].max(initial=0) < 2**32 and step[0] < 2**32 else step
                rows.append((int(r), flush, -step.itemsize, None, kernels.squeeze(step), kernels.squeeze(own[edges[r] : edges[r + 1]]), x[:1].tobytes()))
            return _batch(rows, _PACKED_ARROW)

        for batch in batches:
            ids, gone = _ids(batch.column(0))
            said = batch.column(2).to_numpy()
            data, offsets = kernels.string_bytes(batch.column(1))
            data = kernels.LOWER[data]
            for a, z in kernels.blocks(offsets):
                word, first = kernels.word_hashes(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a], kernels.SPACED)
                hashes, at = kernels.shingle_sets(word, first, words)
                counts = np.diff(at)
                names, others = np.zeros(z - a, dtype=np.uint64), np.zeros(z - a, dtype=np.uint64)
                if some := np.flatnonzero(counts).tolist():
                    for name, salt in ((names, 0x5851F42D4C957F2D), (others, 0x14057B7EF767814F)):
                        name[some] = kernels.mix(np.add.reduceat(kernels.mix(hashes ^ np.uint64(salt)), at[:-1][some]) + counts[some].astype(np.uint64))
                if held and (tokens + len(hashes) > FLUSH_TOKENS or sets + z - a > FLUSH_ROWS):
                    yield out()
                    held.clear()
                    kernels.give_back()
                    flush, tokens, sets = flush + 1, 0, 0
                held.append((ids[a:z], gone[a:z], said[a:z], counts, names, others, hashes))
                tokens, sets = tokens + len(hashes), sets + z - a
        if held:
            yield out()
        held.clear()
        kernels.give_back()

    return pack


def _share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a hash range: keep shingles of two or more documents, with how many (as a log)."""
    blobs, counted = [], []
    for batch in batches:
        table = []
        for part, flush, n, ids, tokens, owners, weights in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if n == _COUNTED:
                counted.append((flush, kernels.expand(tokens, np.uint64), kernels.expand(weights, np.uint32)))
            elif n >= 0 or n == _HOME:
                table.append((part, flush, n, ids, tokens, owners, weights))
            else:
                step = kernels.expand(tokens, np.uint32 if n == -4 else np.uint64).astype(np.uint64)
                step[:1] = np.frombuffer(weights, dtype=np.uint64)
                blobs.append((flush, np.cumsum(step, dtype=np.uint64), kernels.expand(owners, np.uint16)))
        if table:
            yield _batch(table, _PACKED_ARROW)
    if not blobs and not counted:
        return
    value = np.concatenate([b[1] for b in blobs] or [np.zeros(0, np.uint64)])
    value.sort()
    edges = np.flatnonzero(np.r_[True, value[1:] != value[:-1], True]) if len(value) else np.zeros(1, np.int64)
    count, names = np.diff(edges), value[edges[:-1]]
    del value, edges
    if counted:
        names, count = np.concatenate([names, *(c[1] for c in counted)]), np.concatenate([count, *(c[2].astype(np.int64) for c in counted)])
        order = np.argsort(names, kind="stable")
        names, count = names[order], count[order]
        first = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
        names, count = names[first], np.add.reduceat(count, first)
        del order, first
    names, count = names[count > 1], count[count > 1]
    if not len(names):
        return
    for flush, tokens, owners in blobs:
        at = np.minimum(np.searchsorted(names, tokens), len(names) - 1)
        keep = np.flatnonzero(names[at] == tokens)
        if len(keep):
            weight = np.minimum(255, np.round(8 * np.log2(count[at[keep]]))).astype(np.uint8)
            yield _batch([(0, flush, -1, None, kernels.squeeze(tokens[keep]), kernels.squeeze(owners[keep]), kernels.squeeze(weight))], _PACKED_ARROW)
    for flush, tokens, _ in counted:  # shared by what they are: several sets of a block have them
        weight = np.minimum(255, np.round(8 * np.log2(count[np.searchsorted(names, tokens)]))).astype(np.uint8)
        yield _batch([(0, flush, _WEIGHED, None, kernels.squeeze(tokens), None, kernels.squeeze(weight))], _PACKED_ARROW)
    del names, count, blobs, counted
    kernels.give_back()


def _gatherer(per_cent: int):
    """Shared shingles back to their documents' sets, rarest first."""
    schema = pa.schema([(x, pa.int64()) for x in ("doc_id", "text_hash", "row", "n_shingles", "name", "other_name")] + [("central", pa.float64()), ("prefix", pa.int32()), ("tokens", pa.list_(pa.int64()))])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, tuple] = {}
        found: dict[int, list[tuple]] = defaultdict(list)
        home: dict[int, tuple] = {}
        weighed: dict[int, list[tuple]] = defaultdict(list)
        for batch in batches:
            for _, flush, n, ids, tokens, owners, weights in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n >= 0:
                    tables[flush] = (kernels.expand(ids, np.int64), kernels.expand(tokens, np.uint64), kernels.expand(owners, np.int32), kernels.expand(weights, np.uint16))
                elif n == _HOME:
                    home[flush] = (tokens, owners, weights)
                elif n == _WEIGHED:
                    weighed[flush].append((tokens, weights))
                else:
                    found[flush].append((tokens, owners, weights))
        for flush, (ids, names, counts, sets_at) in tables.items():
            (ids, said), (names, others) = np.split(ids, 2), np.split(names, 2)
            n_sets = int((sets_at != 65535).sum())
            row = np.zeros(n_sets, dtype=np.int64)
            row[sets_at[sets_at != 65535]] = np.flatnonzero(sets_at != 65535)
            packed = found.pop(flush, [])
            tokens, owners, weights = (np.concatenate([kernels.expand(p[i], t) for p in packed]) if packed else np.zeros(0, t) for i, t in enumerate((np.uint64, np.uint16, np.uint8)))
            if flush in home:
                here, its, sets_of = (kernels.expand(x, t) for x, t in zip(home.pop(flush), (np.uint64, np.uint16, np.uint32), strict=True))
                told, weight = (np.concatenate([kernels.expand(p[i], t) for p in weighed[flush]]) for i, t in enumerate((np.uint64, np.uint8)))
                weight = weight[np.argsort(told)]  # both have each shingle once
                tokens, owners, weights = np.concatenate([tokens, np.repeat(here, sets_of)]), np.concatenate([owners, its]), np.concatenate([weights, np.repeat(weight, sets_of)])
                del weighed[flush]
            shared = np.bincount(owners, minlength=n_sets)
            size = counts[row]
            least = -(-per_cent * size // 100)
            alive = (shared >= least) & (size > 0)
            keep = alive[owners] if len(owners) else np.zeros(0, bool)
            tokens, owners, weights = tokens[keep], owners[keep], weights[keep]
            order = np.lexsort((tokens, weights, owners))
            tokens, owners, weights = tokens[order], owners[order], weights[order]
            many = np.where(alive, shared, 0)
            central = np.bincount(owners, weights=weights, minlength=n_sets) / np.maximum(size, 1)
            lengths = np.zeros(len(ids), dtype=np.int64)
            lengths[row] = many
            # sets are numbered by their name, not by their row: deal the runs out in row order
            starts = np.r_[0, np.cumsum(many)]
            by_row = np.argsort(row, kind="stable")
            values = np.concatenate([tokens[starts[s] : starts[s + 1]] for s in by_row if many[s]]) if many.any() else tokens[:0]
            prefix, middle = np.zeros(len(ids), dtype=np.int32), np.zeros(len(ids))
            prefix[row], middle[row] = np.where(alive, shared - least + 1, 0), np.where(alive, central, 0)
            longs = [pa.array(ids, mask=ids == _NULL_ID), pa.array(said), pa.array((flush << 16) + np.arange(len(ids))), pa.array(counts.astype(np.int64)), pa.array(names.view(np.int64)), pa.array(others.view(np.int64))]
            runs = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(values.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*longs, pa.array(middle), pa.array(prefix), runs], schema=schema)
        tables.clear()
        found.clear()
        kernels.give_back()

    return gather


def shingle_links(sets: DataFrame, per_cent: int = 75) -> tuple[DataFrame, DataFrame]:
    """(links, labels) between sets (set_id, n_shingles, central, prefix, tokens): links join every
    connected family; labels (id, component) name each set's component by its smallest set_id."""
    sets = sets.withColumn("n_shingles", F.col("n_shingles").cast("long"))  # the bounds below multiply it

    def verify(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link."""
        left = sets.select(F.col("set_id").alias("a"), F.col("n_shingles").alias("na"), F.col("tokens").alias("ta"))
        right = sets.select(F.col("set_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("tokens").alias("tb"))
        both = F.size(F.array_intersect("ta", "tb")).cast("long")
        return materialize(pairs.join(left, "a").join(right, "b").where(100 * both >= per_cent * (F.col("na") + F.col("nb") - both)).select("a", "b"), "links")

    near = f"100 * least(n_shingles, other_n) >= {per_cent} * greatest(n_shingles, other_n)"
    short = F.size("tokens") - F.ceil(2 * per_cent * F.col("n_shingles") / (100 + per_cent)) + 1
    postings = materialize(sets.select("set_id", "n_shingles", "central", F.posexplode(F.slice("tokens", F.lit(1), F.col("prefix"))).alias("at", "token")), "postings")
    lead = postings.groupBy("token").agg(F.max(F.struct("central", "set_id", "n_shingles")).alias("lead"), F.count(F.lit(1)).alias("many")).where("many > 1")
    lead = materialize(lead.select("token", F.col("lead.set_id").alias("leader"), F.col("lead.central").alias("leader_central"), F.col("lead.n_shingles").alias("other_n")), "leaders")
    # each set meets its most central leader; what that leaves apart is the matrix's
    pairs = postings.join(lead, "token").where(f"set_id != leader and {near}").groupBy(F.col("set_id").alias("a")).agg(F.max_by("leader", F.struct("leader_central", "leader")).alias("b"))
    links = verify(pairs)
    nodes = sets.select(F.col("set_id").alias("id"))
    labels = components(nodes, links)

    # The token-group matrix over what the leaders left apart. Of two linked sets the smaller one
    # shares a token of its short prefix with the prefix of the larger one.
    sizes = sets.select("set_id", "n_shingles", F.size("tokens").alias("kept"), short.alias("short"))
    placed = materialize(sizes.join(labels.select(F.col("id").alias("set_id"), F.col("component").alias("label")), "set_id"), "sizes")
    cluster = materialize(placed.groupBy("label").agg(F.count(F.lit(1)).alias("members"), F.sum("kept").alias("mass")), "clusters")
    salt = F.pmod(F.xxhash64("set_id"), F.greatest(F.ceil(F.col("mass") / GROUP_TOKENS), F.ceil(F.col("members") / GROUP_MEMBERS)))
    grouped = placed.join(cluster, "label").withColumn("grp", F.xxhash64("label", F.floor(F.log("n_shingles") * 4), salt))
    grouped = materialize(grouped.select("set_id", "n_shingles", "label", "members", "grp", "short"), "placed")
    release(lead, placed, cluster)
    slots = postings.select("set_id", "token", "at").join(grouped, "set_id")
    open_tokens = postings.select("set_id", "token").join(grouped.select("set_id", "label"), "set_id").groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("token")
    open_tokens = materialize(open_tokens, "open")
    slots = materialize(slots.join(open_tokens, "token", "left_semi").withColumn("early", F.col("at") < F.col("short")), "slots")
    early = F.col("early")
    matrix = slots.groupBy("token", F.col("grp").alias("g")).agg(
        F.first("label").alias("g_label"), F.first("members").alias("g_members"), F.min("n_shingles").alias("g_least"), F.max("n_shingles").alias("g_most"), F.min(F.when(early, F.col("n_shingles"))).alias("g_early")
    )
    matrix = materialize(matrix, "matrix")
    meet = slots.join(matrix, "token").where("label != g_label and (members < g_members or members = g_members and label < g_label)")
    meet = meet.where(f"100 * g_most >= {per_cent} * n_shingles and {per_cent} * g_least <= 100 * n_shingles and (early and g_most >= n_shingles or g_early <= n_shingles)")
    meet = materialize(meet.select("set_id", F.col("g").alias("grp")).distinct(), "meet")
    asked = materialize(grouped.select("set_id", "grp", "n_shingles").join(meet.select("grp").distinct(), "grp", "left_semi"), "asked")
    unions = sets.select("set_id", "tokens").join(asked, "set_id").groupBy("grp").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("all_tokens"), F.min("n_shingles").alias("g_least"))
    unions = materialize(unions, "unions")
    least = F.greatest(per_cent * (100 + per_cent) * F.col("n_shingles"), 100 * per_cent * (F.col("n_shingles") + F.col("g_least")))
    bound = sets.select("set_id", "n_shingles", "tokens").join(meet, "set_id").join(unions, "grp")
    opened = bound.where(100 * (100 + per_cent) * F.size(F.array_intersect("tokens", "all_tokens")).cast("long") >= least).select("set_id", "grp", F.col("n_shingles").alias("other_n"))
    opened = materialize(opened, "opened")
    more = opened.join(grouped.select(F.col("set_id").alias("b"), "n_shingles", "grp"), "grp").where(near).select(F.col("set_id").alias("a"), "b")
    more = verify(more)
    release(postings, grouped, open_tokens, slots, matrix, meet, asked, unions, opened)
    if not more.isEmpty():
        release(labels)
        links = links.union(more)
        labels = components(nodes, links)
    return links, labels


def classify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, per_cent: int = 75) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, component_id (smallest id of its component),
    component (a number that its component alone has), keeper (text_hash and doc_id of one of its rows)."""
    parts = max(2 * partitions(docs.sparkSession), -(-input_bytes(docs, text_col) // PART_BYTES))
    text = F.col(text_col).cast("string")
    packed = docs.select(F.col(id_col).cast("long"), text, F.xxhash64(text)).mapInArrow(_packer(words, parts), _PACKED)
    shared = packed.repartition(parts, "part").mapInArrow(_share, _PACKED)
    rows = materialize(shared.repartition(parts, "flush").mapInArrow(_gatherer(per_cent), _SETS), "sets")

    some, name = rows.where("n_shingles > 0"), ["name", "other_name"]
    sets = materialize(some.where("prefix > 0").dropDuplicates(name).select(*name, F.col("row").alias("set_id"), "n_shingles", "central", "prefix", "tokens"), "distinct")
    _, labels = shingle_links(sets, per_cent)
    numbered = sets.select(*name, "set_id").join(labels.select(F.col("id").alias("set_id"), "component"), "set_id").select(*name, "component")
    keeper = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    classes = some.groupBy(*name).agg(F.min("row").alias("row"), keeper.alias("keeper"))
    classes = materialize(classes.join(numbered, name, "left").select(*name, "keeper", F.coalesce("component", "row").alias("component")), "classes")
    named = materialize(classes.groupBy("component").agg(F.min("keeper").alias("keeper")), "named")
    member = materialize(classes.join(named.withColumnRenamed("keeper", "one"), "component").select(*name, "component", "one"), "members")
    release(sets, labels, classes, named)
    out = some.select("doc_id", "text_hash", "n_shingles", *name).join(member, name)
    out = out.select("doc_id", "text_hash", "n_shingles", F.col("one.doc_id").alias("component_id"), "component", F.struct("one.doc_id", "one.text_hash").alias("keeper"))
    alone = rows.where("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"), F.col("row").alias("component"), F.struct("doc_id", "text_hash").alias("keeper"))
    return out.union(alone)


def jaccard_join(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_shingles long, component_id (smallest id of its component)."""
    return classify(docs, **options).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component: that of its smallest id (null last), then text hash.

    Rows are selected, not ids: of rows that share an id, or have none, only the chosen text stays, and
    of rows that repeat both id and text one. Texts without words link with nothing, so all stay.
    """
    found = classify(docs, id_col=id_col, text_col=text_col, **options).where("n_shingles > 0")
    kept = materialize(found.select(F.coalesce("keeper.doc_id", F.lit(0)).alias("__id"), F.col("keeper.doc_id").isNull().alias("__none"), F.col("keeper.text_hash").alias("__hash")).distinct(), "kept")
    key, text = ["__id", "__none", "__hash"], F.col(text_col).cast("string")
    worded = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.where(worded).withColumns({"__id": F.coalesce(F.col(id_col).cast("long"), F.lit(0)), "__none": F.col(id_col).isNull(), "__hash": F.xxhash64(text)})
    return keyed.join(kept, key, "left_semi").dropDuplicates(key).select(*docs.columns).union(docs.where(~worded))
