"""Mixing sources to target weights by entropy balancing [native].

Each document i of source g gets a rate r_i, the expected number of its copies. Among all rates that meet the
token constraints

    sum over documents of g:  size_i * r_i = target_g,      0 <= r_i <= cap,

the one with the least relative entropy to the prior rates q_i is the exponential tilt

    r_i = min(cap, q_i * exp(lambda_g * size_i)).

lambda is the solution of a convex dual, one dimension for each source. Its Newton iterations run as Spark jobs:
documents are pre-aggregated once to (source, size, prior) cells, then every iteration joins the cells with a state
table of one row a source, sums token mass and curvature by source, and steps. Each source keeps a bracket around its
solution; a step that leaves the bracket, and every second one after the first dozen, halves it instead, so the
iterations end by themselves.

Rounding. Documents of a source whose size agrees in its leading ten bits (and whose rate agrees to 1/32) form a group.
Groups are few whatever the number of documents, so one row a source holds them all. They are walked from large to
small: each gets the whole number of copies nearest to its rate and to what larger groups left open, within what the
smaller ones can still make up for. What is open at the end is less than half the smallest document, unless no whole
copies come nearer. Inside a group copies are dealt evenly, one more to the documents of least hash; the hash up to
which this holds is found from counts of hash ranges, about as many as each range has rows.

Defined cases: a null text has size 0; a null source is a source of its own and sorts last; documents of size 0 keep
their prior rate and take 0 words; repeated rows and rows of one id (also without one) are documents of their own with
equal hashes, so that of a group's ties all get the further copy or none; a null or negative prior counts as 0, and
documents with it take nothing; a source without words has target 0; a target that priors of 0 put out of reach is met
as far as it goes; with a cap that is no whole number copies stop at the whole number below it; an empty table gives
an empty table; texts of any length are counted whole; columns of the input named like those added here are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confluo.llm.common import WORD, drop_stored, stored, without

ADDED = ("size", "source_size", "target", "rate", "copies", "taken")
LEADING = 10  # bits of a size that tell groups apart
RATE_STEPS = 32
WALK = 128  # groups walked before their results are put together


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _numbered(sizes: DataFrame) -> DataFrame:
    """sizes with n, the place of each source by code point, null last: ranges are sorted apart, then offset."""
    spark = sizes.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = stored(sizes.repartitionByRange(ranges, F.col("source").asc_nulls_last()).withColumn("_range", F.spark_partition_id()), "mix-ranges")
    counts = parts.groupBy("_range").agg(F.count("*").alias("_count"))  # one row a range
    offsets = counts.withColumn("_offset", F.sum("_count").over(Window.orderBy("_range")) - F.col("_count")).drop("_count")
    inside = Window.partitionBy("_range").orderBy(F.col("source").asc_nulls_last())
    return parts.withColumn("_row", F.row_number().over(inside)).join(offsets, "_range").withColumn("n", F.col("_offset") + F.col("_row")).drop("_range", "_row", "_offset")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """(source, source_size) -> with target: shares by weight, none above cap times its source's size.

    The excess of sources that hit their cap is shared by weight among the others until none is above. That fixed
    point is a level L with target = min(cap * size, weight * L). Each round keeps the sources that the level fills and
    raises the level for the others; only its sums reach the driver.
    """
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    rows = _numbered(sizes).withColumn("weight", F.element_at(pattern, ((F.col("n") - 1) % len(weights) + 1).cast("int")))
    rows = stored(rows.select("source", "source_size", "weight", (F.col("source_size") * F.lit(float(cap))).alias("ceiling")), "mix-weights")
    total, level, full = rows.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    while True:
        # full sources stay full, as the level only rises
        over = F.col("ceiling") < F.col("weight") * F.lit(level)
        got = rows.agg(F.count_if(over).alias("full"), F.sum(F.when(over, F.col("ceiling"))).alias("held"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if got["full"] == full or not got["weight"]:
            break
        full, level = got["full"], (total - (got["held"] or 0.0)) / got["weight"]
    return rows.select("source", "source_size", F.least(F.col("ceiling"), F.col("weight") * F.lit(level)).alias("target"))


def _rate(prior: Column, lam: Column, size: Column, cap: float) -> Column:
    return F.when(prior > 0, F.least(F.lit(float(cap)), prior * F.exp(lam * size))).otherwise(0.0)


def solve_dual(cells: DataFrame, targets: DataFrame, cap: float, tolerance: float = 1e-9) -> DataFrame:
    """Newton iterations on the dual. cells: (source, size, prior, n); returns (source, source_size, target, lam)."""
    # at 40 all but tiny priors are at the cap, which is the answer for targets that only this meets
    reach = cells.groupBy("source").agg((float(cap) * F.sum(F.when(F.col("prior") > 0, F.col("n") * F.col("size")).otherwise(0.0))).alias("reach"))
    state = targets.alias("t").join(reach.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source"))).select("t.*", "reach")
    below = F.col("target") < F.col("reach") * (1 - 1e-12)
    lam = F.when(below, 0.0).otherwise(F.when(F.col("target") > 0, 40.0).otherwise(0.0))
    state = state.select("source", "source_size", "target", lam.alias("lam"), F.lit(-40.0).alias("low"), F.lit(40.0).alias("high"), (below & (F.col("target") > 0)).alias("open"))
    state, turn = stored(state, "mix-state"), 0
    while not state.where("open").isEmpty():
        # two steps a job
        last, state = state, stored(_newton(cells, _newton(cells, state, cap, tolerance, turn + 1), cap, tolerance, turn + 2), "mix-state")
        drop_stored(last)
        turn += 2
    return state.select("source", "source_size", "target", "lam")


def _newton(cells: DataFrame, state: DataFrame, cap: float, tolerance: float, turn: int) -> DataFrame:
    """One step for the sources that are open."""
    rate = _rate(F.col("prior"), F.col("lam"), F.col("size"), cap)
    mass = F.col("n") * F.col("size")
    names = ["source_size", "target", "lam", "low", "high", "open"]
    sums = (
        cells.alias("c").join(state.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source")))
        .groupBy(F.col("s.source").alias("source"), *names)
        .agg(F.sum(mass * rate).alias("tokens"), F.sum(F.when(rate < cap, mass * F.col("size") * rate).otherwise(0.0)).alias("curvature"))
    )
    above = F.col("tokens") > F.col("target")
    sums = sums.withColumns({"low": F.when(above, F.col("low")).otherwise(F.col("lam")), "high": F.when(above, F.col("lam")).otherwise(F.col("high"))})
    newton = F.col("lam") + F.ln(F.col("target") / F.col("tokens")) * F.col("tokens") / F.col("curvature")
    usable = (F.col("curvature") > 0) & (F.col("tokens") > 0) & F.lit(turn <= 12 or turn % 2 == 0)
    step = F.when(usable, F.when((newton > F.col("low")) & (newton < F.col("high")), newton))
    step = F.coalesce(step, (F.col("low") + F.col("high")) / 2)
    met = F.abs(F.col("tokens") - F.col("target")) <= tolerance * F.col("target")
    going = F.col("open") & ~met & (F.col("high") - F.col("low") > 1e-13)
    return sums.select("source", "source_size", "target", F.when(going, F.round(step, 15)).otherwise(F.col("lam")).alias("lam"), "low", "high", going.alias("open"))


def _group(size: Column, rate: Column) -> Column:
    """The number of a document's group: its rate in steps, the length of its size in bits and their leading ones."""
    cut = F.greatest(F.lit(0), F.length(F.bin(size)) - LEADING)
    head = F.floor(size / F.pow(F.lit(2.0), cut)).cast("long")
    return F.round(rate * RATE_STEPS).cast("long") * (1 << 20) + cut * (1 << 12) + head


def _walk(groups: Column, target: Column, most: int) -> Column:
    """Copies for each of a source's groups, an array of struct(n, mass, plan) from large documents to small."""
    start = F.struct(
        target.cast("double").alias("need"), F.aggregate(groups, F.lit(0.0), lambda a, g: a + g["mass"]).alias("rest"),
        F.aggregate(groups, F.lit(0.0), lambda a, g: a + g["plan"]).alias("plan"), F.array().cast("array<double>").alias("found"),
    )

    def step(state: Column, g: Column) -> Column:
        size = F.when(g["mass"] > 0, g["mass"] / g["n"]).otherwise(1.0)
        rest, plan = F.greatest(F.lit(0.0), state["rest"] - g["mass"]), state["plan"] - g["plan"]
        # within what smaller documents can make up for, if any number is
        low, high = F.ceil(F.round((state["need"] - most * rest) / size, 9)), F.floor(F.round(state["need"] / size, 9))
        nearest = F.round(F.round((state["need"] - plan) / size, 9))
        short, over = state["need"] - high * size - most * rest, (high + 1) * size - state["need"]
        pick = F.when(low <= high, F.greatest(low, F.least(high, nearest))).when(short <= over, high).otherwise(high + 1)
        pick = F.when(g["mass"] > 0, pick).otherwise(F.round(g["even"]))
        pick = F.greatest(F.lit(0.0), F.least(most * g["n"], pick)).cast("double")
        picked = F.transform(F.array(pick), lambda k: F.struct((state["need"] - k * size).alias("need"), rest.alias("rest"), plan.alias("plan"), F.concat(state["found"], F.array(k)).alias("found")))
        return F.get(picked, F.lit(0))

    # results of WALK groups are gathered before they are put together, so that the work grows with the groups alone
    begins = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(groups)), F.lit(WALK))

    def part(state: Column, begin: Column) -> Column:
        fresh = F.struct(state["need"].alias("need"), state["rest"].alias("rest"), state["plan"].alias("plan"), F.array().cast("array<double>").alias("found"))
        done = F.array(F.aggregate(F.slice(groups, begin, F.lit(WALK)), fresh, step))
        return F.get(F.transform(done, lambda d: F.struct(d["need"].alias("need"), d["rest"].alias("rest"), d["plan"].alias("plan"), F.concat(state["found"], d["found"]).alias("found"))), F.lit(0))

    return F.aggregate(begins, start, part, lambda state: state["found"])


def _dealt(rows: DataFrame, state: DataFrame, cap: float) -> DataFrame:
    """(source, group, each, last): every document of a group takes `each` copies, those whose hash is at most `last`
    one more."""

    def joined(a: DataFrame, b: DataFrame, *on: str, how: str = "inner") -> DataFrame:
        found = F.col("a.source").eqNullSafe(F.col("b.source"))
        for c in on:
            found = found & (F.col(f"a.{c}") == F.col(f"b.{c}"))
        return a.alias("a").join(b.alias("b"), found, how)

    key = ["source", "group"]
    own = [F.col("a.source").alias("source"), F.col("a.group").alias("group")]
    sized = rows.groupBy(*key).agg(
        F.count("*").cast("double").alias("n"), F.sum("size").cast("double").alias("mass"),
        F.sum(F.round("rate", 9)).alias("even"), F.sum(F.round(F.col("rate") * F.col("size"), 6)).alias("plan"),
    )
    # by descending size, then by group
    item = F.struct((-F.round(F.col("mass") / F.col("n"), 6)).alias("order"), "group", "n", "mass", "even", "plan")
    groups = sized.groupBy("source").agg(F.array_sort(F.collect_list(item)).alias("groups"))
    walked = joined(groups, state).select("a.source", "groups", _walk(F.col("groups"), F.col("target"), int(cap)).alias("copies"))
    walked = walked.select("source", F.explode(F.arrays_zip("groups", "copies")).alias("x")).select("source", "x.groups.group", "x.groups.n", "x.copies")
    each = F.floor(F.col("copies") / F.col("n"))
    found = walked.select("source", "group", each.alias("each"), (F.col("copies") - each * F.col("n")).cast("long").alias("more"), F.ceil(F.sqrt("n")).alias("ranges"))
    found = stored(found, "mix-groups")
    # a group's documents by range of their hash: the range in which the further copies end is ranked
    range_ = F.floor(F.col("a.hash") / F.lit(float(1 << 62)) * F.col("ranges"))
    partly = joined(rows, found.where("more > 0"), "group").select(*own, "more", range_.alias("range"), "a.hash")
    counts = partly.groupBy(*key, "more", "range").agg(F.count("*").alias("count"))
    before = F.sum("count").over(Window.partitionBy(*key).orderBy("range")) - F.col("count")
    edge = counts.withColumn("before", before).where((F.col("before") < F.col("more")) & (F.col("more") <= F.col("before") + F.col("count")))
    edge = stored(edge.select(*key, "range", (F.col("more") - F.col("before")).alias("left")), "mix-edges")
    last = joined(partly, edge, "group", "range").select(*own, "hash", "left")
    last = last.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("hash"))).where("rank = left").select(*key, F.col("hash").alias("last"))
    return joined(found, last, "group", how="left").select(*own, "each", F.coalesce("last", F.lit(-1)).alias("last"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    cap: float = 3.0,
    seed: int = 7,
    id_col: str = "doc_id",
    size: Column | None = None,
    prior: Column | None = None,
) -> DataFrame:
    """docs with size, source_size, target, rate, copies and taken (= size * copies) of each document.

    weights repeat over the sources in code-point order; size is the number of words unless a column is given; prior
    is each document's rate before the tilt, 1 unless given.
    """
    size = word_count(F.col("text")) if size is None else size.cast("long")
    prior = F.lit(1.0) if prior is None else F.greatest(F.lit(0.0), F.coalesce(prior.cast("double"), F.lit(0.0)))
    hash_ = F.shiftrightunsigned(F.xxhash64(F.col(f"`{id_col}`"), F.lit(seed)), 2)
    docs = docs.withColumns({"_size": size, "_prior": prior, "_hash": hash_})
    docs = without(docs, *ADDED)
    # texts are read here once and once more for the result; everything between works on a few numbers a document
    rows = stored(docs.select("source", F.col("_size").alias("size"), F.col("_prior").alias("prior"), F.col("_hash").alias("hash")), "mix-sizes")
    cells = stored(rows.groupBy("source", "size", "prior").agg(F.count("*").cast("double").alias("n")), "mix-cells")
    sizes = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).cast("long").alias("source_size"))
    state = solve_dual(cells, stored(source_targets(sizes, weights, cap), "mix-targets"), cap)

    def rated(frame: DataFrame, size: str, prior: str) -> DataFrame:
        kept = [F.col(f"d.`{c}`") for c in frame.columns]
        rate = _rate(F.col(f"d.{prior}"), F.col("s.lam"), F.col(f"d.{size}"), cap)
        out = frame.alias("d").join(state.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select(*kept, F.col("s.source_size").alias("_source_size"), F.col("s.target").alias("_target"), rate.alias("rate"))
        return out.withColumn("_group", _group(F.col(size), F.col("rate")))

    slim = rated(rows.where("prior > 0"), "size", "prior").withColumnRenamed("_group", "group")
    dealt = stored(_dealt(slim, state, cap), "mix-copies")
    drop_stored(rows)
    out = rated(docs, "_size", "_prior")
    same = F.col("d.source").eqNullSafe(F.col("g.source")) & (F.col("d._group") == F.col("g.group"))
    same = same & (F.col("d._prior") > 0)
    copies = F.coalesce(F.col("g.each") + F.when(F.col("d._hash") <= F.col("g.last"), 1).otherwise(0), F.lit(0)).cast("long")
    return out.alias("d").join(dealt.alias("g"), same, "left").select(
        *[F.col(f"d.`{c}`") for c in docs.columns if c not in ("_size", "_prior", "_hash")],
        F.col("d._size").alias("size"), F.col("d._source_size").alias("source_size"), F.col("d._target").alias("target"), F.col("d.rate").alias("rate"),
        copies.alias("copies"), (F.col("d._size") * copies).alias("taken"),
    )
