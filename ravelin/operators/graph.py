"""Graph retrieval: adjacency, matching, bounded expansion, chunk recall."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.functions.order import numbered
from ravelin.operators.spread import hubs_of, spread, to_parts, with_parts
from ravelin.sources.scratch import Scratch

DECAY = 0.5


def edges(relations: DataFrame) -> DataFrame:
    """(source, relation, target, direction, edge_ord): each relation from both of its ends."""
    out = relations.select(F.col("head").alias("source"), "relation", F.col("tail").alias("target"), F.lit("outgoing").alias("direction"), (2 * F.col("ord")).alias("edge_ord"))
    back = relations.select(F.col("tail").alias("source"), "relation", F.col("head").alias("target"), F.lit("incoming").alias("direction"), (2 * F.col("ord") + 1).alias("edge_ord"))
    return out.unionByName(back)


def name_forms(entities: DataFrame) -> DataFrame:
    """(name, ord, form, kind): names (0) and aliases (1) as they may stand in a text."""
    return entities.select("name", "ord", F.col("name").alias("form"), F.lit(0).alias("kind")).unionByName(entities.select("name", "ord", F.explode("aliases").alias("form"), F.lit(1).alias("kind"))).where("form <> ''")


def name_cuts(queries: DataFrame, forms: DataFrame) -> DataFrame:
    """(q, form): substrings of texts that begin as some form of their length does; all forms that stand there among them."""
    sizes, starts = _beginnings(forms)
    asked = queries.where("text <> ''").select("q", "text").repartition("q")  # a small file of many queries is one task's
    places = asked.select("q", "text", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("i"))
    places = places.select("q", "text", "i", F.explode(F.array(*map(F.lit, sizes))).alias("m")).select("q", "text", "i", F.substr("text", "i", "m").alias("start"))
    return places.join(starts, "start").where(F.col("i") + F.col("n") - 1 <= F.length("text")).select("q", F.substr("text", "i", "n").alias("form"))


def match_entities(queries: DataFrame, entities: DataFrame, vector_hits: DataFrame | None = None, k: int = 5, least: float = 0.5) -> DataFrame:
    """(q, name, score, match, rank): entities whose name stands in the query (1.0), then those with an alias there
    (0.9), then vector hits (q, name, score) above ``least`` that are neither, up to ``k`` in this order.

    Names and aliases are keys of an equality join: a query is cut into the substrings that may be one, those that begin
    as some name of their length does, instead of every query with every entity. Beginnings are as long as their table
    stays small, so that of a query little more than its names is moved; ``entities`` is read several times.
    """
    forms = name_forms(entities)
    grams = name_cuts(queries, forms)
    found = grams.join(forms, "form").groupBy("q", "name").agg(F.min("kind").alias("kind"), F.min("ord").alias("ord"))
    hits = found.select("q", "name", F.when(F.col("kind") == 0, 1.0).otherwise(0.9).alias("score"), F.when(F.col("kind") == 0, "exact").otherwise("alias").alias("match"), "kind", "ord")
    if vector_hits is not None:
        more = vector_hits.where(F.col("score") > least).join(hits, ["q", "name"], "left_anti")
        more = more.withColumn("ord", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "name")).cast("long"))
        hits = hits.unionByName(more.select("q", "name", "score", F.lit("vector").alias("match"), F.lit(2).alias("kind"), "ord"))
    order = Window.partitionBy("q").orderBy("kind", "ord", "name")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("kind", "ord")


#: Beginnings of names that go to every task, with the lengths of these; the most characters of a beginning.
NAME_STARTS, START_CHARS = 50_000, 4


def _beginnings(forms: DataFrame) -> tuple[list[int], DataFrame]:
    """(lengths of beginnings, (start, n)): how forms of ``n`` characters begin, by as many characters as keep the rows
    few; where even one character does not, the rows are not sent to every task. A shorter form is its own beginning."""
    tries = range(1, START_CHARS + 1)
    start = lambda m: F.substr("form", F.lit(1), F.lit(m))
    counts = [F.approx_count_distinct(F.struct(start(m), F.length("form"))) for m in tries]
    found = forms.agg(F.collect_set(F.least(F.length("form"), F.lit(START_CHARS))).alias("sizes"), *counts).first()
    few = [m for m in tries if found[m] <= NAME_STARTS]
    chars = few[-1] if few else 1
    rows = forms.select(start(chars).alias("start"), F.length("form").alias("n")).distinct()
    return sorted({min(n, chars) for n in found.sizes}) or [1], F.broadcast(rows) if few else rows


#: So many names of a frontier go to every task, to leave out edges that start elsewhere before these are shuffled.
FRONT_NAMES = 500_000


def _from(front: DataFrame, edge_rows: DataFrame, name: str, scratch: Scratch) -> DataFrame:
    """The rows of edges that start at a name of the frontier (source, ...), or all where these names are many."""
    names = scratch.write(front.select("source").distinct(), name)
    return edge_rows.join(F.broadcast(names), "source", "left_semi") if names.limit(FRONT_NAMES + 1).count() <= FRONT_NAMES else edge_rows


def reachable(seeds: DataFrame, adjacency: DataFrame, depth: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """(q, name, hops) of everything within ``depth`` steps of (q, name), the seeds included though unknown. Each
    frontier is written once; edges are read as they are, and what they lead to counts once."""
    scratch = scratch or Scratch(seeds.sparkSession, "reach")
    steps = adjacency.select("source", "target")
    hubs = scratch.write(spread(steps, "source", ["target"])[1], "hubs")
    dealt = with_parts(steps, "source", hubs, ["target"])
    seen = front = scratch.write(seeds.select("q", "name").distinct().withColumn("hops", F.lit(0)), "seeds")
    for hop in range(1, depth + 1):
        asked = to_parts(front.select("q", F.col("name").alias("source")), "source", hubs, "source")
        after = asked.join(_from(asked, dealt, f"from{hop}", scratch), ["source", "part"]).select("q", F.col("target").alias("name")).distinct()
        front = scratch.write(after.join(seen, ["q", "name"], "left_anti").withColumn("hops", F.lit(hop)), f"front{hop}")
        seen = seen.unionByName(front)
    return seen


def _few(rows: DataFrame, most: int) -> bool:
    return rows.limit(most + 1).count() <= most


def _meet(rows: DataFrame, names: DataFrame, key: str, by: list[str], name: str, scratch: Scratch, how: str = "inner") -> DataFrame:
    """``rows`` joined on ``key`` with a table of names, which is written once: up to ``FRONT_NAMES`` of its rows go to
    every task, and ``rows`` stay where they are; beyond, names of many rows are dealt over parts by ``by``. Of stored
    rows, those are not read whose row group has no name between the first and the last."""
    names = scratch.write(names, name)
    if how == "inner":
        ends = names.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
        rows = rows.where(F.col(key).between(ends.low, ends.high))
    if _few(names, FRONT_NAMES):
        return rows.join(F.broadcast(names), key, how)
    hubs = scratch.write(spread(rows, key, by)[1], f"{name}-hubs")
    return with_parts(rows, key, hubs, by).join(to_parts(names, key, hubs, key), [key, "part"], how).drop("part")


def expand_weighted(seeds: DataFrame, adjacency: DataFrame, depth: int = 2, decay: float = DECAY, scratch: Scratch | None = None) -> DataFrame:
    """(q, name, score, ord) of the seeds (q, name, score, ord) and what they lead to, each step worth ``decay``.

    The first discovery counts, in the order of the frontier and then of its edges, and is never raised later; so
    survivors are numbered in that order, and their numbers order the next frontier. Each frontier is written once, sorted
    over ranges: no task numbers the whole frontier of a query. Names of many edges are dealt over parts where a frontier
    is too large for every task. Repeated edges count once.
    """
    return _expanded(seeds, adjacency, depth, decay, scratch or Scratch(seeds.sparkSession, "expansion")).select("q", "name", "score", "ord")


def _expanded(seeds: DataFrame, adjacency: DataFrame, depth: int, decay: float, scratch: Scratch) -> DataFrame:
    """(q, name, score, ord, root, hop): as of ``expand_weighted``, with the place of the seed that led there first."""
    first = seeds.groupBy("q", "name").agg(F.min(F.struct(F.col("ord").cast("long").alias("ord"), F.col("score").cast("double").alias("score"))).alias("x"))
    seen = scratch.write(first.select("q", "name", "x.score", "x.ord", F.col("x.ord").alias("root"), F.lit(0).alias("hop")), "seeds")
    steps = adjacency.select("source", "target", "edge_ord")
    front, base = seen, 1 << 32
    for hop in range(1, depth + 1):
        asked = front.select("q", F.col("name").alias("source"), "score", F.col("ord").alias("parent_ord"), "root")
        near = _meet(steps, asked, "source", ["target", "edge_ord"], f"from{hop}", scratch)
        near = near.groupBy("q", F.col("target").alias("name")).agg(F.min(F.struct("parent_ord", "edge_ord", "score", "root")).alias("x"))
        near = near.join(seen.select("q", "name"), ["q", "name"], "left_anti").select("q", "name", "x.*")
        placed = numbered(near, ["q", "parent_ord", "edge_ord", "name"], f"hop{hop}", scratch)
        low = scratch.write(placed.groupBy("q").agg(F.min(f"hop{hop}").alias("low")), f"low{hop}")
        front = placed.join(low, "q").select("q", "name", (F.col("score") * decay).alias("score"), (F.lit(base) + 1 + F.col(f"hop{hop}") - F.col("low")).cast("long").alias("ord"), "root", F.lit(hop).alias("hop"))
        seen, base = seen.unionByName(front), base << 1
    return seen


def chunk_links(entities: DataFrame, key: list[str]) -> DataFrame:
    """(key…, id): the chunks of rows that have them in a list, or of a link table (key…, chunk) as it is."""
    return entities.select(*key, F.explode("source_chunks").alias("id") if "source_chunks" in entities.columns else F.col("chunk").alias("id"))


#: Queries whose scores are added up side by side: a name says by one bit of a number which of them found it.
SIDE = 32


def related_chunks(scored: DataFrame, entities: DataFrame, chunks: DataFrame | None = None, first: int = 20, k: int = 10, scratch: Scratch | None = None) -> DataFrame:
    """(q, id, score, rank, matched_entities): chunks by the summed score of their entities, which are a link table
    (name, chunk), where repeated links count once, or rows with lists of chunks. Of the first ``first``, those whose body
    is missing go, and ``k`` of the others stay. ``scored`` has a name once a query.

    A link is moved once to its name and once to its chunk, whatever the number of queries: there, ``SIDE`` queries are
    added up at a time, and only chunks that can be among the first of a query leave the task. The places of their
    entities, which order equal scores, are looked up for these alone. Names and chunks of many links are dealt over
    parts; such a chunk's sums are added up once more.
    """
    scratch = scratch or Scratch(scored.sparkSession, "related")
    named = scored.select("q", "name", "score", "ord")
    matched = named.groupBy("q").agg(F.count("*").alias("matched_entities"))
    order = scratch.write(numbered(named.select("q").distinct(), ["q"], "no", scratch), "queries")
    asked = named.join(order, "q").groupBy("name", F.floor(F.col("no") / SIDE).cast("int").alias("block"), F.col("score").cast("double").alias("score"))
    asked = asked.agg(F.bit_or(F.expr(f"shiftleft(1L, cast(no % {SIDE} as int))")).alias("bits"))
    every = chunk_links(entities, ["name"]).where("id IS NOT NULL")
    whole = _summed(asked, every, first, scratch)
    best = F.rank().over(Window.partitionBy("no").orderBy(F.desc("score")))
    near = whole.withColumn("best", best).where(F.col("best") <= first).join(order, "no").select("q", "id", "score")
    near = scratch.write(near, "near")
    own = every.join(near.select("id").distinct(), "id", "left_semi")
    seen = named.join(own, "name").join(near.select("q", "id"), ["q", "id"]).groupBy("q", "id").agg(F.min("ord").alias("ord"))
    part = near.join(seen, ["q", "id"]).select("q", "id", "score", F.struct("ord", "id").alias("seen"))
    return _ranked(part, chunks, first, k).join(matched, "q")


def _summed(asked: DataFrame, every: DataFrame, first: int, scratch: Scratch, name: str = "") -> DataFrame:
    """(id, no, score) of asked names (name, block, score, bits) and links (name, id): the summed scores of chunks, of
    those that can be among the ``first`` of a query."""
    hubs = scratch.write(spread(every, "name", ["id"])[1], f"hubs{name}")
    links = with_parts(every, "name", hubs, ["id"])
    met = to_parts(asked, "name", hubs, "name").join(links, ["name", "part"]).groupBy("name", "part", "id", "block", "score").agg(F.first("bits").alias("bits"))
    many = scratch.write(hubs_of(every, "id"), f"many{name}")
    met = with_parts(met.drop("part"), "id", many, ["name"]).join(many, "id", "left").select("id", "part", F.col("parts").isNotNull().alias("dealt"), "block", "score", "bits")
    sums = met.repartition("id", "part").sortWithinPartitions("id", "part", "block").mapInArrow(_sums(first), T.StructType([T.StructField("id", every.schema["id"].dataType), *T._parse_datatype_string("dealt boolean, no long, score double").fields]))
    sums = scratch.write(sums, f"sums{name}")
    whole = sums.where("NOT dealt").select("id", "no", "score").unionByName(sums.where("dealt").groupBy("id", "no").agg(F.sum("score").alias("score")))
    return whole.withColumn("score", F.round("score", 6))


def _sums(first: int):
    """From (id, part, dealt, block, score, bits) sorted by id, part and block to (id, dealt, no, score): the sum of every
    query of a block that has a bit. Of chunks that are not dealt out, those below the ``first`` best of their query that
    the task has seen so far are left out; equal ones stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        held: pa.Table | None = None

        def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            starts = np.r_[0, _turns(rows)]
            bits, block = rows.column("bits").to_numpy(), rows.column("block").to_numpy()
            dealt = rows.column("dealt").to_numpy()[starts]
            for lo in range(0, len(starts), 4096):
                at = starts[lo : lo + 4096]
                end = starts[lo + 4096] if lo + 4096 < len(starts) else len(bits)
                mine = bits[at[0] : end, None] >> np.arange(SIDE) & 1
                total = np.add.reduceat(mine * rows.column("score").to_numpy()[at[0] : end, None], at - at[0], axis=0)
                has = np.maximum.reduceat(mine, at - at[0], axis=0) > 0
                for b in np.unique(block[at]):
                    pick = np.flatnonzero(block[at] == b)
                    own, there, all_of = total[pick], has[pick], dealt[lo + pick]
                    cold = np.where(there & ~all_of[:, None], own, -np.inf)
                    top = np.concatenate([best.get(b, np.full((first, SIDE), -np.inf)), cold])
                    best[b] = -np.partition(-top, first - 1, axis=0)[:first]
                    # Sums are rounded later: what falls short by less than that stays.
                    row, bit = np.nonzero(there & (all_of[:, None] | (own >= best[b].min(axis=0) - 2e-6)))
                    ids = rows.column("id").take(pa.array(at[pick[row]])).combine_chunks()
                    yield pa.record_batch([ids, pa.array(all_of[row]), pa.array(int(b) * SIDE + bit), pa.array(own[row, bit])], names=["id", "dealt", "no", "score"])

        for batch in batches:
            now = pa.table(batch) if held is None else pa.concat_tables([held, pa.table(batch)]).combine_chunks()
            turns = _turns(now)
            if not len(turns):
                held = now
                continue
            held = now.slice(turns[-1])
            yield from work(now.slice(0, turns[-1]))
        if held is not None and held.num_rows:
            yield from work(held)

    return run


def _turns(rows: pa.Table) -> np.ndarray:
    """Where a row has another id, part or block than the one before."""
    n = rows.num_rows
    if n < 2:
        return np.empty(0, np.int64)
    new = np.zeros(n - 1, bool)
    for c in ("id", "part", "block"):
        own = rows.column(c).combine_chunks()
        new |= pc.not_equal(own.slice(1), own.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new) + 1


#: Steps that an excess over the least bound is rounded up to, a byte for each query; a chunk with more links to known
#: names than bytes can add up has no bound. Chunks of a task and query that are scored first.
LEVELS, MOST_LINKS, TRIED = 15, 255 // 15, 64


def recall_chunks(seeds: DataFrame, adjacency: DataFrame, links: DataFrame, chunks: DataFrame | None = None, depth: int = 2, decay: float = DECAY, first: int = 20, k: int = 10, scratch: Scratch | None = None) -> DataFrame:
    """(q, id, score, rank): what ``related_chunks`` gives of ``expand_weighted``, for seeds (q, name, score, ord) whose
    ``ord`` is a place of its own in each query, without all that the last step reaches as a row for each query.

    That step is taken by all queries at once, a bit for each: which seed led there first, and so the score, needs no
    numbers. Every chunk then has an upper bound by its links alone: what the last step adds to a name is known, and how
    much names that were met before are worth beyond that is added up in bytes, rounded up. Chunks of the best bounds are
    scored, which gives each query a score that ``first`` chunks reach; of all others, those whose bound reaches it are
    scored. Places of names, which order equal scores, are looked up for what is left. Edges and links may repeat, and are
    read a few times: they should be written. A query that leads on but reaches fewer than ``first`` chunks has no score to
    leave others out by, so then all are scored. More than ``SIDE`` queries, or scores that are not positive, take the plain way.
    """
    scratch = scratch or Scratch(seeds.sparkSession, "recall")
    seeds = scratch.write(seeds.select("q", "name", F.col("score").cast("double").alias("score"), F.col("ord").cast("long").alias("ord")), "asked")
    if depth < 1 or not _few(seeds.select("q").distinct(), SIDE) or not seeds.where("score IS NULL OR NOT score > 0").isEmpty():
        return related_chunks(expand_weighted(seeds, adjacency, depth, decay, scratch), links, chunks, first, k, scratch).drop("matched_entities")
    every = chunk_links(links, ["name"]).where("id IS NOT NULL AND name IS NOT NULL")
    order = seeds.select("q").distinct().withColumn("no", F.row_number().over(Window.orderBy("q")) - 1)  # at most SIDE rows
    known = scratch.write(_expanded(seeds, adjacency, depth - 1, decay, scratch).join(F.broadcast(order), "q"), "known")
    front = known.where(F.col("hop") == depth - 1)
    bits = F.bit_or(F.expr("shiftleft(1L, no)")).alias("bits")
    last = _last_step(front, known, adjacency, decay, bits, scratch)
    asked = known.groupBy("name", "score").agg(bits).unionByName(last).select("name", F.lit(0).alias("block"), "score", "bits")
    asked = scratch.write(asked, "states")

    step = {r.no: r.most * decay for r in front.groupBy("no").agg(F.max("score").alias("most")).collect()}
    base = np.array([step.get(no, 0.0) for no in range(SIDE)])
    bounds, unit = _bounds(known, every, base, scratch)

    def scored(ids: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        ids = scratch.write(ids, f"ids-{name}")
        own = every.join(F.broadcast(ids) if _few(ids, FRONT_NAMES) else ids, "id", "left_semi").distinct()
        own = scratch.write(own, f"links-{name}")
        return _summed(asked, own, first, scratch, f"-{name}"), own

    ids, queries = T.StructType([bounds.schema["id"]]), order.count()
    tried = scored(bounds.mapInArrow(_likeliest(base, unit, queries), ids).distinct(), "tried")[0]
    nth = F.row_number().over(Window.partitionBy("no").orderBy(F.desc("score")))
    reached = {r.no: r.score for r in tried.withColumn("nth", nth).where(F.col("nth") == first).collect()}
    least = np.array([reached.get(no, -np.inf) for no in range(SIDE)])
    whole, own = scored(bounds.mapInArrow(_reaching(base, unit, least, queries), ids), "left")
    best = F.rank().over(Window.partitionBy("no").orderBy(F.desc("score")))
    near = scratch.write(whole.withColumn("best", best).where(F.col("best") <= first).join(F.broadcast(order), "no").select("q", "id", "score"), "near")
    seen = _first_places(near, own, known, front, adjacency, scratch)
    return _ranked(near.join(seen, ["q", "id"]).select("q", "id", "score", F.struct("ord", "id").alias("seen")), chunks, first, k)


def _last_step(front: DataFrame, known: DataFrame, adjacency: DataFrame, decay: float, bits, scratch: Scratch) -> DataFrame:
    """(name, score, bits) of what the frontier leads to and is not known. Places follow those of the seeds that led there,
    so the first discovery is by the least of these: a query that one has is taken from all later ones."""
    lead = front.groupBy(F.col("name").alias("source"), "root", "score").agg(bits)
    met = _meet(adjacency.select("source", "target"), lead, "source", ["target"], "lead", scratch)
    met = met.groupBy(F.col("target").alias("name"), "root", "score").agg(F.bit_or("bits").alias("bits"))
    had = known.groupBy("name").agg(bits).withColumns({"root": F.lit(None).cast("long"), "score": F.lit(None).cast("double")})
    earlier = Window.partitionBy("name").orderBy(F.asc_nulls_first("root")).rowsBetween(Window.unboundedPreceding, -1)
    new = met.unionByName(had).withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce(F.bit_or("bits").over(earlier), F.lit(0).cast("long")))))
    return new.where("root IS NOT NULL AND bits <> 0").groupBy("name", (F.col("score") * decay).alias("score")).agg(F.bit_or("bits").alias("bits"))


def _bounds(known: DataFrame, every: DataFrame, base: np.ndarray, scratch: Scratch) -> tuple[DataFrame, float]:
    """((id, n, met, b0, b1, b2, b3), unit): links of each chunk, those to known names, and for every query a byte with
    what these are worth beyond ``base``, in units, rounded up; null where the bytes do not hold it."""
    beyond = F.col("score") - F.element_at(F.array(*map(F.lit, base.tolist())), F.col("no") + 1)
    worth = known.withColumn("beyond", F.greatest(beyond, F.lit(0.0)))
    unit = (worth.agg(F.max("beyond").alias("most")).first().most or 0.0) / LEVELS or 1.0
    level = F.least(F.ceil(F.col("beyond") / unit), F.lit(LEVELS)).cast("long")
    places = range(SIDE // 8)
    put = lambda p: F.sum(F.when(F.floor(F.col("no") / 8) == p, F.call_function("shiftleft", level, (F.col("no") % 8 * 8).cast("int"))).otherwise(0)).alias(f"b{p}")
    # The last byte of a long has its sign: no level reaches that alone, and sums that do are null.
    names = worth.groupBy("name").agg(*map(put, places), F.lit(1).alias("one"))
    marked = _meet(every, names, "name", ["id"], "worth", scratch, "left")
    added = [F.try_sum(F.coalesce(f"b{p}", F.lit(0).cast("long"))).alias(f"b{p}") for p in places]
    return scratch.write(marked.groupBy("id").agg(F.count("*").alias("n"), F.count("one").alias("met"), *added), "bounds"), unit


def _upper(rows: pa.Table, base: np.ndarray, unit: float) -> np.ndarray:
    """The most that the chunks of bound rows can score, by query."""
    parts = [rows.column(f"b{p}") for p in range(SIDE // 8)]
    lanes = np.stack([pc.fill_null(x, 0).to_numpy().astype("<i8") for x in parts], axis=1).view(np.uint8)
    out = rows.column("n").to_numpy()[:, None] * base + unit * lanes
    open_ = rows.column("met").to_numpy() > MOST_LINKS
    for x in parts:
        open_ |= pc.is_null(x).to_numpy()
    out[open_] = np.inf
    return out


def _likeliest(base: np.ndarray, unit: float, queries: int):
    """The ids of a task's ``TRIED`` best bounds of every query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        floor = np.full(queries, -np.inf)  # what a bound has to be above to come among them
        for batch in batches:
            rows = pa.table(batch)
            rows = rows.filter(pa.array((_upper(rows, base, unit)[:, :queries] > floor).any(axis=1)))
            kept = rows if kept is None else pa.concat_tables([kept, rows]).combine_chunks()
            if kept.num_rows > TRIED:
                upper = _upper(kept, base, unit)[:, :queries]
                at = np.argpartition(-upper, TRIED - 1, axis=0)[:TRIED]
                floor = np.take_along_axis(upper, at, axis=0).min(axis=0)
                kept = kept.take(pa.array(np.unique(at))).combine_chunks()
        if kept is not None:
            yield from kept.select(["id"]).to_batches()

    return run


def _reaching(base: np.ndarray, unit: float, least: np.ndarray, queries: int):
    """The ids whose bound reaches the least score of some query; scores are rounded, so what falls short by less stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.table(batch)
            upper = _upper(rows, base, unit)[:, :queries]
            hit = ((upper > 0) & (upper >= least[:queries] - 2e-6)).any(axis=1)
            yield from rows.filter(pa.array(hit)).select(["id"]).combine_chunks().to_batches()

    return run


def _first_places(near: DataFrame, own: DataFrame, known: DataFrame, front: DataFrame, adjacency: DataFrame, scratch: Scratch) -> DataFrame:
    """(q, id, ord) of chunks (q, id): the first place of their names, known ones first; what the last step reaches stands
    by its parent, edge and name."""
    place = lambda *x: F.struct(*(c.alias(n) for n, c in zip(("last", "parent", "edge", "name"), x)))
    no = F.lit(0).cast("long")
    met = own.join(F.broadcast(near.select("id").distinct()) if _few(near, FRONT_NAMES) else near.select("id").distinct(), "id", "left_semi")
    early = known.select("q", "name", "ord").join(met, "name").join(near.select("q", "id"), ["q", "id"])
    early = scratch.write(early.groupBy("q", "id").agg(F.min(place(F.lit(0), F.col("ord"), no, F.lit(""))).alias("ord")), "early")
    late = scratch.write(near.select("q", "id").join(early, ["q", "id"], "left_anti").join(met, "id"), "late")
    asked = front.select("q", F.col("name").alias("source"), F.col("ord").alias("parent"))
    steps = _meet(adjacency.select("source", "target", "edge_ord"), late.select(F.col("name").alias("target")).distinct(), "target", ["source", "edge_ord"], "targets", scratch)
    found = _meet(steps, asked, "source", ["target", "edge_ord"], "parents", scratch).groupBy("q", F.col("target").alias("name")).agg(F.min(F.struct("parent", "edge_ord")).alias("x"))
    found = late.join(found, ["q", "name"]).groupBy("q", "id").agg(F.min(place(F.lit(1), F.col("x.parent"), F.col("x.edge_ord"), F.col("name"))).alias("ord"))
    return early.unionByName(found)


def graph_search(queries: DataFrame, entities: DataFrame, adjacency: DataFrame, chunks: DataFrame | None = None, vector_hits: DataFrame | None = None, depth: int = 2, first: int = 20, k: int = 10, links: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, expansion) of (q, text): ``hits`` as of ``related_chunks``; ``expansion`` has the matched entities of each
    query that matched any and the names of the first ``first`` it was expanded to, seeds included."""
    seeds = match_entities(queries, entities, vector_hits).withColumnRenamed("rank", "ord")
    scored = expand_weighted(seeds, adjacency, depth)
    place = F.row_number().over(Window.partitionBy("q").orderBy("ord", "name"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"])
    expanded = scored.withColumn("place", place).where(F.col("place") <= first).groupBy("q").agg(names.alias("expanded"))
    matched = seeds.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("matched"))
    return related_chunks(scored, entities if links is None else links, chunks, first, k), matched.join(expanded, "q")


def relation_chunks(hits: DataFrame, relations: DataFrame, chunks: DataFrame | None = None, k: int = 10) -> DataFrame:
    """(q, id, score, rank): chunks by the summed similarity of the relations (q, head, relation, tail, score, rank)."""
    part = hits.join(chunk_links(relations, ["head", "relation", "tail"]), ["head", "relation", "tail"]).groupBy("q", "id").agg(F.round(F.sum("score"), 6).alias("score"), F.min(F.struct("rank", "id")).alias("seen"))
    return _ranked(part, chunks, k, k)


def _ranked(part: DataFrame, chunks: DataFrame | None, first: int, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), "seen")
    top = part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    if chunks is not None:
        again = Window.partitionBy("q").orderBy("rank")
        top = top.join(chunks.select("id"), "id", "left_semi").withColumn("rank", F.row_number().over(again))
    return top.where(F.col("rank") <= k).select("q", "id", "score", "rank")


def relation_search(scores: DataFrame, k: int = 10, least: float = 0.5) -> DataFrame:
    """The ``k`` best relations of each query, of those the ones at ``least`` or above."""
    order = Window.partitionBy("q").orderBy(F.desc("score"), "head", "relation", "tail")
    return scores.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= k) & (F.col("score") >= least))


def paths(adjacency: DataFrame, centre: DataFrame, most: int = 200) -> DataFrame:
    """Edges on undirected paths of one or two steps from (name) rows, one per pair of ends, in a fixed order."""
    scratch = Scratch(adjacency.sparkSession, "paths")
    steps = adjacency.select("source", "target")
    one = scratch.write(steps.join(centre.select(F.col("name").alias("source")), "source", "left_semi").distinct(), "one")
    ends = one.select(F.col("target").alias("source")).distinct()
    two = _from(ends, steps, "ends", scratch).join(ends, "source", "left_semi").distinct()
    return one.unionByName(two).distinct().orderBy("source", "target").limit(most)


def simple_paths(adjacency: DataFrame, centres: DataFrame, most: int = 200) -> DataFrame:
    """(centre, path_no, target, hops, edges): the first ``most`` undirected paths of one or two relations from each
    (name), none of which has a relation twice; ``edges`` are the relations' numbers, shorter paths and lower numbers
    first. A path may lead back to its centre by another relation.

    Only as many first steps are carried on as there can be paths, and of those only the ones that lead on, so the two
    steps of a hub do not meet.
    """
    # A loop stands there from both of its ends, but is one step: what is read of a step twice goes where it is used.
    scratch = Scratch(adjacency.sparkSession, "paths")
    steps = adjacency.select("source", "target", F.floor(F.col("edge_ord") / 2).alias("edge"))
    nth = lambda *order: F.row_number().over(Window.partitionBy("centre").orderBy(*order))
    one = steps.join(centres.select(F.col("name").alias("source")).distinct(), "source").select(F.col("source").alias("centre"), "target", F.col("edge").alias("e1")).distinct()
    one = scratch.write(one, "one")
    from_one = _from(one.select(F.col("target").alias("source")), steps, "vias", scratch)
    degree = from_one.join(one.select(F.col("target").alias("source")).distinct(), "source", "left_semi").distinct().groupBy("source").agg(F.count("*").alias("degree")).where("degree > 1")
    leads = one.join(degree.select(F.col("source").alias("target")), "target", "left_semi").withColumn("n", nth("e1")).where(F.col("n") <= most)
    leads = scratch.write(leads.select("centre", F.col("target").alias("via"), "e1"), "leads")
    second = _from(leads.select(F.col("via").alias("source")), steps, "leading", scratch).select(F.col("source").alias("via"), F.col("target").alias("end"), F.col("edge").alias("e2"))
    two = leads.join(second, "via").where("e1 <> e2").distinct().select("centre", F.col("end").alias("target"), F.array("e1", "e2").alias("edges"))
    every = one.select("centre", "target", F.array("e1").alias("edges")).unionByName(two).withColumn("hops", F.size("edges").cast("long"))
    return every.withColumn("path_no", nth("hops", "edges").cast("long")).where(F.col("path_no") <= most).select("centre", "path_no", "target", "hops", "edges")


def view_nodes(found: DataFrame, entities: DataFrame) -> DataFrame:
    """(centre, place, name, type) of the ends of paths: the centre first, then each where it first ends a path. A name
    that is no entity has the type OTHER."""
    ends = found.groupBy("centre", F.col("target").alias("name")).agg(F.min("path_no").alias("place"))
    own = found.select("centre", F.col("centre").alias("name"), F.lit(0).cast("long").alias("place")).distinct()
    first = own.unionByName(ends).groupBy("centre", "name").agg(F.min("place").alias("place"))
    typed = first.join(entities.select("name", "type"), "name", "left").withColumn("type", F.coalesce("type", F.lit("OTHER")))
    return typed.withColumn("place", F.row_number().over(Window.partitionBy("centre").orderBy("place")).cast("long")).select("centre", "place", "name", "type")


def view_edges(found: DataFrame) -> DataFrame:
    """(centre, place, source, target) of the view: one edge for each end of the paths, where it came first."""
    pairs = found.groupBy("centre", "target").agg(F.min("path_no").alias("place"))
    return pairs.select("centre", F.row_number().over(Window.partitionBy("centre").orderBy("place")).cast("long").alias("place"), F.col("centre").alias("source"), "target")
