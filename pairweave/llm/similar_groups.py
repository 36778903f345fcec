"""Grouping records into similarity clusters: spherical k-means over hashed neighbourhoods, then an exact trim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairweave.operators.edges import symmetrize
from pairweave.operators.rounds import is_empty
from pairweave.operators.skew import heavy_split_join, label_ends
from pairweave.runtime import cut, derived
from pairweave.sources.tables import table

#: Dimensions that features are hashed to; vectors have a bounded size, however many records a record is similar to.
DIMENSIONS = 128
#: Cosine from which centroids that similar records link become one cluster.
CLOSE = 0.65
#: Vectors are broadcast for a join up to so many counted ones (some 5 MB).
SMALL_SIDE = 5_000


def hashed_vectors(arcs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """``(id, degree, x, norm)``: each record's similar records, and itself, as features weighing their similarity,
    hashed to ``dimensions``, with the vector's length.

    ``arcs(src, dst, s)`` holds both directions of every pair once. Weights are summed per feature before anything is
    gathered, so no row has more than ``dimensions`` entries.
    """
    own = arcs.select("src").distinct().select("src", F.col("src").alias("dst"), F.lit(1.0).alias("s"))
    feature = F.pmod(F.xxhash64("dst"), F.lit(dimensions)).cast("int")
    rows = arcs.unionByName(own).groupBy(F.col("src").alias("id"), feature.alias("f")).agg(F.sum("s").alias("v"), F.count(F.lit(1)).alias("n"))
    per = rows.groupBy("id").agg((F.sum("n") - 1).alias("degree"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"), _entries())
    return per.select("id", "degree", _dense("m", dimensions).alias("x"), "norm")


def _dense(of: str, dimensions: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.try_element_at(F.col(of), i), F.lit(0.0)))


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def _entries() -> Column:
    return F.map_from_entries(F.collect_list(F.struct("f", "v"))).alias("m")


def _chance(ident: str, *salt: int) -> Column:
    """A number from 0 to 1 that depends on the record and the salt alone."""
    return F.pmod(F.xxhash64(F.col(ident), *[F.lit(s) for s in salt]), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _nearest_seed(likeness: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(id, c, cos)``: the seed most like each record among itself and its similar records; ties to the smaller."""
    met = likeness.join(seeds.select(F.col("id").alias("dst")), "dst", "left_semi")
    best = F.min(F.struct((-F.round("cos", 9)).alias("neg"), F.col("dst").alias("c")))
    return met.groupBy(F.col("src").alias("id")).agg(best.alias("b")).select("id", F.col("b.c").alias("c"), (-F.col("b.neg")).alias("cos"))


def seeded(vectors: DataFrame, likeness: DataFrame, *, rounds: int = 3, oversampling: float = 0.5, close: float = CLOSE, seed: int = 1) -> DataFrame:
    """``(id, c)``: every record with the nearest seed, by parallel oversampling (k-means||).

    The number of clusters isn't known, but in a graph of separate groups of like records the sum of 1 / (degree + 1)
    is just that, so it stands for k. A first sample of ``oversampling`` times k is drawn; then in each round every
    record becomes a seed with the chance ``oversampling`` k d / phi, where d is its distance from its nearest seed and
    phi the sum of all distances. At the end every record without a seed within ``close`` is a seed of its own, so that
    none is assigned to what it isn't like. The seeds are clustered in turn by :func:`merge_centroids`.
    """
    facts = vectors.agg(F.count(F.lit(1)).alias("n"), F.sum(1.0 / (F.col("degree") + 1)).alias("k")).first()
    n, want = facts["n"], oversampling * (facts["k"] or 0.0)
    chosen = cut(vectors.select("id").filter(_chance("id", seed, 0) < want / max(1, n)))
    for r in range(1, rounds + 1):
        far = cut(derived(vectors, "id").join(_nearest_seed(likeness, chosen), "id", "left").select("id", F.least(F.lit(1.0), 1 - F.coalesce("cos", F.lit(0.0))).alias("d")))
        phi = far.agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("phi")).first()["phi"]
        fresh = far.filter(_chance("id", seed, r) < want * F.col("d") / max(phi, 1e-12)).select("id")
        chosen = cut(chosen.unionByName(fresh).distinct())
    near = vectors.select("id", "degree").join(_nearest_seed(likeness, chosen), "id", "left")
    return cut(near.select("id", "degree", F.when(F.col("cos") >= close, F.col("c")).otherwise(F.col("id")).alias("c")))


def _sums(vectors: DataFrame, state: DataFrame, dimensions: int) -> DataFrame:
    """``(c, y, norm)``: summed directions of the records of each cluster, added up per dimension before the shuffle."""
    parts = vectors.select("id", "x", "norm").join(state.select("id", "c"), "id").select("c", "norm", F.posexplode("x").alias("f", "v")).filter("v <> 0")
    per = parts.groupBy("c", "f").agg(F.sum(F.col("v") / F.col("norm")).alias("v"))
    per = per.groupBy("c").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"), _entries())
    return per.select("c", _dense("m", dimensions).alias("y"), "norm")


def merge_centroids(arcs: DataFrame, vectors: DataFrame, state: DataFrame, n_arcs: int, *, close: float = CLOSE, dimensions: int = DIMENSIONS) -> DataFrame | None:
    """``(id, degree, c)`` after joining clusters whose centroids have a cosine of ``close``; None if none do.

    Only clusters that similar records link are compared. In each round, clusters without a larger close one stay, and
    all others that are close to some of these join the closest; then centroids are taken anew.
    """
    merged = None
    while True:
        links = label_ends(arcs.select("src", "dst"), state, n_arcs).filter("a < b").select("a", "b").distinct()
        weights = state.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sum("degree").alias("arcs"))
        sums = cut(_sums(vectors, state, dimensions).join(weights, "c"))
        ends = [derived(sums, F.col("c").alias(x), F.struct((-F.col("n")).alias("neg"), F.col("c").alias("c")).alias(f"k{x}"), F.col("y").alias(f"y{x}"), F.col("norm").alias(f"n{x}"), "arcs") for x in "ab"]
        rated = heavy_split_join(heavy_split_join(links, ends[0], "a", "arcs", n_arcs, small_side=SMALL_SIDE), ends[1], "b", "arcs", n_arcs, small_side=SMALL_SIDE)
        cos = rated.select("ka", "kb", F.round(_dot(F.col("ya"), F.col("yb")) / (F.col("na") * F.col("nb")), 9).alias("cos"))
        there, back = F.struct(F.col("ka").alias("k"), F.col("kb").alias("of")), F.struct(F.col("kb").alias("k"), F.col("ka").alias("of"))
        close_ones = cut(cos.select("cos", F.explode(F.array(there, back)).alias("_e")).select("cos", "_e.*")).filter(F.col("cos") >= close)
        heads = close_ones.groupBy("k").agg(F.min("of").alias("of")).filter("k < of").select(F.col("k").alias("of"))
        joins = close_ones.join(heads, "of").groupBy("k").agg(F.min(F.struct((-F.col("cos")).alias("neg"), "of")).alias("to"))
        joins = cut(joins.select(F.col("k.c").alias("c"), F.col("to.of.c").alias("into"), (-F.col("k.neg")).alias("n")))
        if is_empty(joins):
            return merged
        state = merged = cut(heavy_split_join(state, joins, "c", "n", n_arcs, how="left").select("id", "degree", F.coalesce("into", "c").alias("c")))


def reassign(arcs: DataFrame, vectors: DataFrame, state: DataFrame, n_arcs: int, *, dimensions: int = DIMENSIONS) -> DataFrame | None:
    """``(id, degree, c)`` after one turn of k-means: records go to the nearest centroid among their own and those of
    similar records; None if all stay.

    A record doesn't count in its own cluster's centroid, which would hold it there; so one that is alone goes to the
    nearest cluster of two or more. Records all of whose similar records share their cluster aren't compared.
    """
    other = label_ends(arcs.select("src", "dst"), state, n_arcs).filter("a <> b").select(F.col("src").alias("id"), F.col("a").alias("own"), "b").distinct()
    other = cut(other)
    if is_empty(other):
        return None
    weights = state.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sum("degree").alias("arcs"))
    sums = cut(_sums(vectors, state, dimensions).join(weights, "c").withColumnsRenamed({"c": "b", "norm": "length"}))
    asked = other.select("id", "own", "b").unionByName(other.select("id", "own", F.col("own").alias("b")).distinct())
    rated = heavy_split_join(asked, sums, "b", "arcs", n_arcs, small_side=SMALL_SIDE).filter((F.col("n") > 1) | (F.col("own") == F.col("b"))).join(vectors.select("id", "x", "norm"), "id")
    rated = cut(rated.select("id", "own", "b", "length", (_dot(F.col("x"), F.col("y")) / F.col("norm")).alias("along")))
    left = F.sqrt(F.greatest(F.lit(0.0), F.col("length") * F.col("length") - 2 * F.col("along") + 1))
    own = F.when(left > 1e-6, (F.col("along") - 1) / left).otherwise(0.0)
    cos = F.round(F.when(F.col("own") == F.col("b"), own).otherwise(F.col("along") / F.col("length")), 9)
    order = F.struct((-cos).alias("neg"), (F.col("own") != F.col("b")).alias("away"), F.col("b").alias("c"))
    moved = cut(rated.groupBy("id", "own").agg(F.min(order).alias("to")).filter("to.away").select("id", F.col("to.c").alias("to")))
    if is_empty(moved):
        return None
    return cut(state.join(moved, "id", "left").select("id", "degree", F.coalesce("to", "c").alias("c")))


def k_means(arcs: DataFrame, vectors: DataFrame, *, iterations: int = 20, close: float = CLOSE, dimensions: int = DIMENSIONS, seed: int = 1) -> DataFrame:
    """``(id, degree, c)`` by spherical k-means over ``vectors`` (see :func:`hashed_vectors`) from :func:`seeded` ones.

    Clusters are joined by :func:`merge_centroids` and records moved by :func:`reassign` in turns, until neither
    changes anything or ``iterations`` moves were made. A record's vector shares features with what it is similar to,
    so only centroids of similar records are ever candidates, and work grows with the pairs.
    """
    n_arcs = arcs.count()
    x, y = (derived(vectors, F.col("id").alias(end), F.col("x").alias(f"x_{end}"), F.col("norm").alias(f"n_{end}"), "degree") for end in ("src", "dst"))
    ends = heavy_split_join(heavy_split_join(arcs, x, "src", "degree", n_arcs, small_side=SMALL_SIDE), y, "dst", "degree", n_arcs, small_side=SMALL_SIDE)
    likeness = ends.select("src", "dst", (_dot(F.col("x_src"), F.col("x_dst")) / (F.col("n_src") * F.col("n_dst"))).alias("cos"))
    likeness = cut(likeness.unionByName(vectors.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("cos"))))
    state = seeded(vectors, likeness, close=close, seed=seed)
    for turn in range(iterations):
        merged = merge_centroids(arcs, vectors, state, n_arcs, close=close, dimensions=dimensions)
        if merged is None and turn:
            break
        state = state if merged is None else merged
        moved = reassign(arcs, vectors, state, n_arcs, dimensions=dimensions)
        if moved is None:
            break
        state = moved
    return state


def trimmed(arcs: DataFrame, state: DataFrame) -> DataFrame:
    """``(id, c)``: the clusters of ``state(id, degree, c)`` without the members that are similar to at most half of the
    others, so that every member left is similar to more than half of the others left.

    What a member lacks is half of the others less its similar ones. In each round the member that lacks most leaves
    its cluster, and all that lack at least half as much, so a few rounds settle a cluster of any size; clusters that
    hold already are set aside. Nothing is added to a cluster here: who can be together is for :func:`k_means` to say.
    """
    n_arcs = arcs.count()
    open_, settled = state.select("id", "degree", "c"), None
    inside = cut(label_ends(arcs.select("src", "dst"), cut(open_), n_arcs).filter("a = b").select("src", "dst", F.col("a").alias("c")))
    while True:
        near = inside.groupBy(F.col("src").alias("id"), "c").agg(F.count(F.lit(1)).alias("s"))
        rated = cut(open_.join(near, ["id", "c"], "left").select("id", "degree", "c", F.coalesce("s", F.lit(0)).alias("s")))
        sizes = rated.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("least"))
        sizes = cut(sizes.filter("n > 1").select("c", "n", (F.col("n") - 1 - 2 * F.col("least")).alias("worst")))
        sized = heavy_split_join(rated, derived(sizes, "c", "n", "worst", F.col("n").alias("_n")), "c", "_n", n_arcs)
        held = sized.filter("worst < 0").select("id", "c")
        settled = held if settled is None else settled.unionByName(held)
        bad = sized.filter("worst >= 0")
        lacks = F.col("n") - 1 - 2 * F.col("s")
        first = bad.groupBy("c").agg(F.max(F.struct(lacks.alias("lacks"), "id")).alias("first"))
        kept = bad.join(first, "c").filter((F.col("id") != F.col("first.id")) & ((2 * lacks < F.col("worst")) | (F.col("worst") < 4))).select("id", "degree", "c")
        open_ = cut(kept)
        if is_empty(open_):
            return settled
        alive = open_.select("id", "c")
        inside = inside.join(alive.withColumnRenamed("id", "src"), ["src", "c"], "left_semi").join(alive.withColumnRenamed("id", "dst"), ["dst", "c"], "left_semi")
        inside = cut(inside.select("src", "dst", "c"))


def similar_groups(pairs: DataFrame, *, dimensions: int = DIMENSIONS, close: float = CLOSE, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Groups of at least two mutually similar records, and each group's description.

    ``pairs(a, b, s)`` holds pairs of similar records. Either order and repeats count once, with the highest
    similarity; pairs of a record with itself and pairs with nulls don't count. Records become hashed vectors
    (:func:`hashed_vectors`), k-means from oversampled seeds makes the groups (:func:`k_means`), and an exact trim takes
    out members that aren't similar to more than half of the others (:func:`trimmed`). Records that are in no group then
    are clustered again among themselves, until no more groups come out.

    Result: ``(group_id, id)`` with the smallest member as group_id, and ``(group_id, size, typical)`` with up to
    three members nearest to the group's centroid. Empty tables give empty results.
    """
    a, b = F.col("a"), F.col("b")
    known = pairs.filter(a.isNotNull() & b.isNotNull() & (a != b) & F.col("s").isNotNull())
    edges = known.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), "s").groupBy("src", "dst").agg(F.max("s").alias("s"))
    arcs = cut(symmetrize(edges))
    first_vectors, members = None, None
    while True:
        vectors = cut(hashed_vectors(arcs, dimensions))
        first_vectors = first_vectors or vectors
        found = cut(trimmed(arcs, k_means(arcs, vectors, close=close, dimensions=dimensions, seed=seed)))
        members = found if members is None else members.unionByName(found)
        if is_empty(found):
            break
        taken = found.select("id")
        arcs = cut(arcs.join(taken.withColumnRenamed("id", "src"), "src", "left_anti").join(taken.withColumnRenamed("id", "dst"), "dst", "left_anti"))
        if is_empty(arcs):
            break
    members = cut(members)
    names = members.groupBy("c").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("size"))
    groups = cut(heavy_split_join(members, cut(names).withColumn("_n", F.col("size")), "c", "_n", members.count()).select("group_id", "size", "id"))
    return groups.select("group_id", "id"), _described(first_vectors, groups, dimensions)


def _described(vectors: DataFrame, groups: DataFrame, dimensions: int, typical: int = 3) -> DataFrame:
    state = groups.select("id", F.col("group_id").alias("c"), "size")
    sums = _sums(vectors, state, dimensions).withColumnRenamed("norm", "length")
    rows = vectors.select("id", "x", "norm").join(state, "id").join(sums, "c")
    cos = rows.select("c", "id", "size", F.round(_dot(F.col("x"), F.col("y")) / (F.col("norm") * F.col("length")), 9).alias("cos"))
    place = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("cos"), "id"))  # limited before the shuffle
    near = cos.withColumn("place", place).filter(F.col("place") <= typical)
    lists = near.groupBy("c", "size").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("typical"))
    return lists.select(F.col("c").alias("group_id"), "size", "typical")


def member_pairs(groups: DataFrame, *, block: int = 1_000) -> DataFrame:
    """``(id1, id2)``, id1 < id2: all pairs of members of ``groups(group_id, id)``.

    The rows asked for are the square of a group's size, so a large group is cut into blocks of members, each of which
    meets the whole group in a task of its own.
    """
    sizes = groups.groupBy("group_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    sized = groups.join(sizes, "group_id")
    left = sized.select("group_id", F.col("id").alias("id1"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("part"))
    right = sized.select("group_id", F.col("id").alias("id2"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"))
    return left.join(right, ["group_id", "part"]).filter("id1 < id2").select("id1", "id2")


def _similar(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "vir61_ani", "id1", "id2", "ani")
    share = F.when(F.col("ani") > 1, F.col("ani") / 100).otherwise(F.col("ani"))
    return rows.filter(~F.isnan("ani") & (share >= 0.95)).select(F.col("id1").alias("a"), F.col("id2").alias("b"), share.alias("s"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of genomes of the same group."""
    return member_pairs(similar_groups(_similar(spark, folder))[0])


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Size, most typical members and most frequent labels of every group."""
    groups, described = similar_groups(_similar(spark, folder))
    labels = table(spark, folder, "vir61_species", "genome", "species_cluster").filter("genome is not null and species_cluster is not null").distinct()
    per = groups.join(labels, groups["id"] == labels["genome"]).groupBy("group_id", "species_cluster").agg(F.count(F.lit(1)).alias("n"))
    top = per.groupBy("group_id").agg(F.min(F.struct((-F.col("n")).alias("neg"), "species_cluster")).alias("t"), F.sum("n").alias("n_labelled"))
    out = described.join(top.select("group_id", F.col("t.species_cluster").alias("species_cluster"), "n_labelled"), "group_id", "left")
    return out.select("group_id", "size", F.concat_ws(" ", "typical").alias("typical"), "species_cluster", F.coalesce("n_labelled", F.lit(0)).alias("n_labelled"))


def p2_holds(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the groups: members similar to at most half of the others, members of several groups, groups
    of one; there are none of these."""
    similar = _similar(spark, folder).filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
    groups = cut(similar_groups(_similar(spark, folder))[0])
    arcs = cut(symmetrize(similar))
    degrees = arcs.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    labels = cut(groups.join(degrees, "id").select("id", "degree", F.col("group_id").alias("c")))
    near = label_ends(arcs, labels, arcs.count()).filter("a = b").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("s"))
    sizes = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    per = groups.join(near, "id", "left").join(sizes, "group_id")
    unfit = per.agg(F.count_if(2 * F.coalesce("s", F.lit(0)) <= F.col("n") - 1).alias("n_unfit"))
    shared = groups.groupBy("id").count().agg(F.count_if(F.col("count") > 1).alias("n_shared"))
    single = sizes.agg(F.count_if(F.col("n") < 2).alias("n_single"))
    out = unfit.unionByName(shared, allowMissingColumns=True).unionByName(single, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in ("n_unfit", "n_shared", "n_single")])


QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups, "p2_holds": p2_holds}
ORACLE = {"p2_holds": "select 0::bigint as n_unfit, 0::bigint as n_shared, 0::bigint as n_single"}
