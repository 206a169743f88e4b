"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are summed by the set of sources they belong to. Words flow from patterns to the sources' quotas; a pattern's
words can be taken up to ``repeats`` times, each further pass at a higher cost, so repetition is used where nothing else
fills a quota. What a pattern sends is then taken from its documents: whole passes over all of them, and a last part in
the order of a seeded hash, of which the last document may be taken in part.

Sums by pattern, one number each, are all that the driver sees; a source that shares no document with another one needs no
flow, so that there may be any number of these. The seeded order is cut into hash buckets, so that only the documents of one
bucket of each pattern are ever sorted together.

Defined results: a null text has no words; documents without words take 0; a text of any length is counted whole, and the
last one of a quota is cut after a word; a null source is a source of its own, the last one; rows are told apart by doc_id
and text, and equal rows are interchangeable; ties of the seeded hash go by doc_id; an empty table gives an empty table.
Columns other than ``doc_id``, ``text`` and ``source`` are not read by ``mix``.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spanlens.llm.shared import stage

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
REPEATS = 3
SEED = 20240229
BUCKETS = 4096
#: Tables by pattern of at most so many rows are broadcast; larger ones are joined by key.
BROADCAST = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], repeats: int = REPEATS) -> list[float]:
    """Shares of the sum of ``sizes`` by weight, none above ``repeats`` times its size; the excess is shared again by weight."""
    out, total = [0.0] * len(sizes), float(sum(sizes))
    live = list(range(len(sizes)))
    while live:
        unit = total / sum(weights[i] for i in live)
        over = [i for i in live if unit * weights[i] > repeats * sizes[i]]
        if not over:
            for i in live:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = float(repeats * sizes[i])
            total -= out[i]
        gone = set(over)
        live = [i for i in live if i not in gone]
    return out


def flow(patterns: list[tuple[frozenset[int], int]], quotas: list[int], repeats: int = REPEATS) -> list[dict[int, int]]:
    """For each pattern (sources, words) the words it sends to each source: a maximum flow of least cost.

    Pass r over a pattern costs r squared a word. Successive shortest paths with potentials; amounts are integers."""
    n, m = len(patterns), len(quotas)
    start, end = n + m, n + m + 1
    graph: list[list[int]] = [[] for _ in range(n + m + 2)]
    to, room, cost = [], [], []

    def arc(a: int, b: int, cap: int, c: int) -> int:
        graph[a].append(len(to))
        to.append(b), room.append(cap), cost.append(c)
        graph[b].append(len(to))
        to.append(a), room.append(0), cost.append(-c)
        return len(to) - 2

    sent: list[dict[int, int]] = []
    for p, (sources, words) in enumerate(patterns):
        for r in range(repeats):
            arc(start, p, words, r * r)
        sent.append({s: arc(p, n + s, repeats * words, 0) for s in sorted(sources)})
    for s, q in enumerate(quotas):
        arc(n + s, end, q, 0)
    potential = [0] * len(graph)
    while True:
        far = [float("inf")] * len(graph)
        by = [-1] * len(graph)
        far[start], todo = 0, [(0, start)]
        while todo:
            d, a = heapq.heappop(todo)
            if d > far[a]:
                continue
            for e in graph[a]:
                if room[e] and (x := d + cost[e] + potential[a] - potential[to[e]]) < far[to[e]]:
                    far[to[e]], by[to[e]] = x, e
                    heapq.heappush(todo, (x, to[e]))
        if by[end] < 0:
            break
        potential = [p + min(f, far[end]) for p, f in zip(potential, far, strict=True)]
        path, at = [], end
        while at != start:
            path.append(by[at])
            at = to[by[at] ^ 1]
        more = min(room[e] for e in path)
        for e in path:
            room[e] -= more
            room[e ^ 1] += more
    return [{s: room[e ^ 1] for s, e in x.items()} for x in sent]


def solve(sums: list[tuple[tuple[int, ...], int]], quotas: list[int], repeats: int = REPEATS) -> list[int]:
    """The words that each pattern (its sources, its words) sends. Sources that share no document with others need no flow:
    their own pattern fills their quota as far as it can; the others are one flow."""
    shared = {i for own, _ in sums if len(own) > 1 for i in own}
    out = [min(quotas[own[0]], repeats * words) if len(own) == 1 else 0 for own, words in sums]
    rest = [k for k, (own, _) in enumerate(sums) if shared.intersection(own)]
    at = {i: k for k, i in enumerate(sorted(shared))}
    sent = flow([(frozenset(at[i] for i in sums[k][0]), sums[k][1]) for k in rest], [quotas[i] for i in sorted(shared)], repeats)
    for k, x in zip(rest, sent, strict=True):
        out[k] = sum(x.values())
    return out


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, members: str | None = None, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """(key, mark, doc_id, size, source_size, target, taken) of every row: ``taken`` words, counting repetitions, go into the mix.

    ``members`` names an array column of the sources a document belongs to; without it a document belongs to ``source``.
    ``key`` and ``mark`` identify rows by doc_id and text. Weights repeat over the sources in the order of code points, null
    last; source_size and target are those of the document's first source."""
    own = F.array("source") if members is None else F.array_sort(F.array_distinct(members))
    rows = stage(docs.select(*identity(seed), F.col("doc_id").cast("long").alias("doc_id"), own.alias("of"), word_count(F.col("text")).alias("size")), "sizes")
    sums = [(tuple(r["of"]), r["words"]) for r in rows.groupBy("of").agg(F.sum("size").alias("words")).collect()]
    sums.sort(key=lambda x: [(s is None, s or "") for s in x[0]])
    names = sorted({s for of, _ in sums for s in of}, key=lambda s: (s is None, s or ""))
    at = {s: i for i, s in enumerate(names)}
    size = [0] * len(names)
    for of, words in sums:
        for s in of:
            size[at[s]] += words
    total = sum(words for _, words in sums)
    wanted = targets(size, [weights[i % len(weights)] for i in range(len(names))], repeats) if members is None else _shared(size, total, weights, repeats)
    sent = solve([(tuple(at[s] for s in of), words) for of, words in sums], [round(t) for t in wanted], repeats)
    spark = docs.sparkSession
    plan = []
    for (of, words), took in zip(sums, sent, strict=True):
        passes, rest = divmod(took, words) if words else (0, 0)
        first = at[of[0]] if of else None
        plan.append((list(of), passes, rest, size[first] if first is not None else 0, wanted[first] if first is not None else 0.0))
    small = F.broadcast if len(plan) <= BROADCAST else lambda df: df
    kind = T.StructType([T.StructField("of", T.ArrayType(T.StringType())), *(T.StructField(c, T.LongType()) for c in ("passes", "rest", "source_size")), T.StructField("target", T.DoubleType())])
    plans = spark.createDataFrame(plan, kind).withColumn("pattern", F.to_json(F.struct("of"), {"ignoreNullFields": "false"})).drop("of")
    bucket = F.shiftrightunsigned("key", 64 - (BUCKETS - 1).bit_length()).cast("int")
    rows = rows.withColumns({"pattern": F.to_json(F.struct("of"), {"ignoreNullFields": "false"}), "bucket": bucket}).drop("of")
    w = Window.partitionBy("pattern").orderBy("bucket")
    counts = rows.groupBy("pattern", "bucket").agg(F.sum("size").alias("words"))
    before = counts.select("pattern", "bucket", "words", (F.sum("words").over(w) - F.col("words")).alias("before")).join(small(plans), "pattern")
    cut = before.where("before < rest and before + words >= rest").select("pattern", F.col("bucket").alias("cut"), F.col("before").alias("cut_before"))
    cuts = spark.createDataFrame(cut.collect(), "pattern string, cut int, cut_before long")
    known = rows.join(small(plans), "pattern").join(small(cuts), "pattern", "left")
    within = F.sum("size").over(Window.partitionBy("pattern").orderBy("key", "mark", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    split = known.where("bucket = cut").withColumn("room", F.col("rest") - F.col("cut_before") - F.coalesce(within, F.lit(0)))
    part = F.greatest(F.lit(0), F.least("size", "room"))
    plain = known.where("cut is null or bucket <> cut").withColumn("part", F.when(F.col("bucket") < F.col("cut"), F.col("size")).otherwise(0))
    both = plain.unionByName(split.withColumn("part", part).drop("room"))
    return both.select("key", "mark", "doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("part")).cast("long").alias("taken"))


def identity(seed: int = SEED) -> list[Column]:
    """Two hashes that name a row by doc_id and text; the first one, read without a sign, is its place in the seeded order."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("text")))
    key = F.conv(F.substring(digest, 1, 16), 16, -10).cast("long")
    return [key.alias("key"), F.xxhash64(F.lit(seed), F.col("text"), F.col("doc_id")).alias("mark")]


def _shared(size: list[int], total: int, weights: tuple[float, ...], repeats: int) -> list[float]:
    """Targets where sources overlap: their sizes add up to more than there is, so shares are of the true total."""
    out = targets(size, [weights[i % len(weights)] for i in range(len(size))], repeats)
    scale = total / sum(out) if sum(out) else 0.0
    return [x * min(1.0, scale) for x in out]


def op3_mixing_flow(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).drop("key", "mark")


def apply_mix(docs: DataFrame) -> DataFrame:
    """The rows of the mix with the columns of ``docs``: a document repeats as often as it is taken whole; where it is
    taken in part, a last row has the text up to the end of that many words (``n_chars`` follows). Documents without
    words stay once, since they weigh nothing. Rows are carried in a struct, so that columns may have any name."""
    taken = mix(docs.select("doc_id", "text", "source"))
    plan = stage(taken.groupBy("key", "mark", "size").agg(F.sort_array(F.collect_list("taken")).alias("all")), "taken")
    rows = docs.select(*identity(), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    joined = rows.join(plan.where(F.size("all") == 1).select("key", "mark", "size", F.col("all")[0].alias("taken")), ["key", "mark"])
    again = plan.where(F.size("all") > 1)
    if not again.isEmpty():  # equal rows are dealt their amounts in order
        number = F.row_number().over(Window.partitionBy("key", "mark").orderBy(F.lit(1)))
        dealt = again.select("key", "mark", "size", F.posexplode("all").alias("i", "taken"))
        same = rows.join(again.select("key", "mark"), ["key", "mark"], "left_semi").withColumn("i", number - 1)
        joined = joined.unionByName(same.join(dealt, ["key", "mark", "i"]).drop("i"))
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(1)).cast("int")
    rest = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(F.lit(0)).cast("int")
    ends = F.concat(F.array_repeat(F.lit(-1), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    out = joined.select("row", F.explode(ends).alias("end"))
    body = F.split("row.text", "(?<=[^\\x20\\x09-\\x0D])(?=[\\x20\\x09-\\x0D])")
    part = F.array_join(F.slice(body, 1, F.greatest("end", F.lit(1))), "")
    own = {"text": F.when(F.col("end") < 0, F.col("row.text")).otherwise(part)}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col("end") < 0, F.col("row.n_chars")).otherwise(F.char_length(part).cast("long"))
    return out.select(*(own[c].alias(c) if c in own else F.col(f"row.`{c}`") for c in docs.columns))
