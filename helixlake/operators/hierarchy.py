"""Classification hierarchies, their datasets, and leak-free splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import filter_codes
from .scratch import written

#: Identity levels and the cluster columns that make their keys.
LEVELS = {"S35": ["s"], "S60": ["s", "o"], "S95": ["s", "o", "l"], "S100": ["s", "o", "l", "i"]}


def build_nodes(domains: DataFrame, names: DataFrame | None = None, code: str = "cath_code") -> DataFrame:
    """All prefixes of all codes, with level, parent and key; names join where a table has them."""
    parts = F.split(code, r"\.")
    one = domains.select(parts.alias("p")).distinct().select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("level"))
    cut = lambda n: F.array_join(F.slice("p", 1, n), ".")
    nodes = one.select(cut(F.col("level")).alias(code), "level", F.when(F.col("level") > 1, cut(F.greatest(F.lit(1), F.col("level") - 1))).alias("parent_code")).distinct()
    nodes = nodes.withColumn("h5_key", F.concat(F.lit("/"), F.translate(code, ".", "/")))
    return nodes if names is None else nodes.join(names, code, "left")


def directory_nodes(inventory: DataFrame, root: str = "", names: DataFrame | None = None, path: str = "path", code: str = "cath_code") -> DataFrame:
    """The folders of a file inventory as a hierarchy of any depth: each folder above a file (below ``root``) is a node, with
    level, parent, key, how many files lie in it and how many in it and below. Branches may differ in depth, and a folder may
    have files and folders. Folder names become the parts of the code; ``names`` (code, ...) joins where it has them. Files
    right in ``root`` and files elsewhere belong to no node; repeated paths count once."""
    top = root.rstrip("/") + "/" if root else ""
    inside = inventory.select(path).distinct().where(F.col(path).startswith(top)) if top else inventory.select(path).distinct()
    parts = F.filter(F.split(F.substring(F.col(path), F.lit(len(top) + 1), F.length(path)), "/"), lambda x: x != "")
    folders = inside.select(F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - 1)).alias("p")).where(F.size("p") > 0)
    folders = folders.groupBy("p").agg(F.count("*").alias("n"))  # as many rows as folders from here on
    steps = folders.select("p", "n", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("level"))
    own = steps.select(F.slice("p", 1, F.col("level")).alias("p"), "level", "n", (F.col("level") == F.size("p")).alias("here"))
    nodes = own.groupBy("p", "level").agg(F.sum(F.when(F.col("here"), F.col("n")).otherwise(0)).alias("n_files"), F.sum("n").alias("n_below"))
    dotted = lambda p: F.array_join(p, ".")
    parent = F.when(F.col("level") > 1, dotted(F.slice("p", 1, F.greatest(F.lit(1), F.col("level") - 1))))
    out = nodes.select(dotted(F.col("p")).alias(code), "level", parent.alias("parent_code"), F.concat(F.lit("/"), F.array_join("p", "/")).alias("h5_key"), "n_files", "n_below")
    return out if names is None else out.join(names, code, "left")


def expand(nodes: DataFrame, keep: list[str], skip: list[str] = (), level: int = 4) -> DataFrame:
    """The nodes of a level below partial codes, without those below the skipped ones."""
    return filter_codes(nodes.where(F.col("level") == level), keep, list(skip))


def in_request_order(df: DataFrame, keys: list, key: str, ignore: list = ()) -> DataFrame:
    """Rows of the keys in the order asked for; a key asked for twice comes twice."""
    spark = df.sparkSession
    asked = spark.createDataFrame([(i, k) for i, k in enumerate(keys) if k not in set(ignore)], f"position long, {key} {dict(df.dtypes)[key]}")
    return df.join(asked, key)  # the planner knows the size of the caller's list


def representatives(domains: DataFrame, reps: DataFrame, code: str = "cath_code") -> DataFrame:
    """For each family how many representatives there are, and which of them no domain stands for."""
    found = reps.join(domains.select("cath_domain", F.lit(True).alias("found")).distinct(), "cath_domain", "left")
    return found.groupBy(code).agg(F.count("*").alias("total_domains"), F.count_if(F.col("found").isNull()).alias("n_missing"), F.min(F.when(F.col("found").isNull(), F.col("cath_domain"))).alias("first_missing"))


def by_ranges(df: DataFrame, by: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """Running totals along an order inside each group, without a task that sees a whole group: rows are dealt by ranges and
    written with the number of their range; totals of the ranges before are added to those in a range. ``sums``: new column
    to the column it totals, "" for a count of rows (which numbers them from 1)."""
    rows = written(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    one = lambda c: F.lit(1).cast("long") if c == "" else F.col(c)
    parts = rows.groupBy(*by, "_range").agg(*(F.sum(one(c)).alias(n) for n, c in sums.items()))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select(*by, "_range", *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_{n}") for n in sums))
    own = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(base, [*by, "_range"]).withColumns({n: F.col(f"_{n}") + F.sum(one(c)).over(own) for n, c in sums.items()})
    return out.drop("_range", *(f"_{n}" for n in sums))


def label_encode(df: DataFrame, col: str, name: str = "label") -> DataFrame:
    """0..n-1 by the order of the distinct values, which are ranked on their own, never the rows. A null value has the
    label null."""
    values = by_ranges(df.select(col).where(F.col(col).isNotNull()).distinct().withColumn("_all", F.lit(0)), ["_all"], [col], {name: ""}).select(col, (F.col(name) - 1).cast("int").alias(name))
    return df.join(values, col, "left")


def _cut(sizes: DataFrame, scope: list[str], share: float, margin: float = 0.01) -> DataFrame:
    """Which clusters (rows scope, k, n of what is left, with all) the next split takes: those up to the cut.

    Start at int(groups * share); from there the cut moves down while too many rows are in, and up while too few are;
    it stops inside the margin, or one past it."""
    f = by_ranges(sizes, scope, ["k"], {"up_to": "n", "j": ""}).withColumn("f", F.col("up_to") / F.col("rows")).drop("up_to")
    lo, hi = share - margin, share + margin
    k0 = F.floor(F.col("groups") * share)
    below, above = (F.col("j") < k0) & (F.col("f") <= hi), (F.col("j") >= k0) & (F.col("f") >= lo)
    s = f.groupBy(*scope).agg(
        F.count("*").alias("m"), F.first(k0).alias("k0"), F.coalesce(F.max(F.when(F.col("j") <= k0, F.col("f"))), F.lit(0.0)).alias("f0"),
        F.coalesce(F.max(F.when(below, F.col("j"))), F.lit(0)).alias("down"), F.coalesce(F.max(F.when(below, F.col("f"))), F.lit(0.0)).alias("f_down"),
        F.min(F.when(above, F.col("j"))).alias("up"), F.min(F.when(above, F.col("f"))).alias("f_up"),
    )
    cut = (
        F.when((F.col("f0") >= lo) & (F.col("f0") <= hi), F.least("k0", "m"))
        .when((F.col("f0") > hi) & (F.col("k0") > F.col("m")), F.col("m"))
        .when(F.col("f0") > hi, F.when(F.col("f_down") >= lo, F.col("down")).otherwise(F.col("down") + 1))
        .when(F.col("up").isNull(), F.col("m"))
        .otherwise(F.when(F.col("f_up") <= hi, F.col("up")).otherwise(F.col("up") - 1))
    )
    cuts = s.select(*scope, cut.alias("cut"))
    return f.join(cuts, scope).withColumn("taken", F.col("j") <= F.col("cut")).drop("f", "j", "cut")


def named_shares(shares: dict[str, float] | float | list[float] | tuple[float, ...]) -> dict[str, float]:
    """Shares by name. One number, or a list of one, is that of train, and validation and test have half of the rest each; of
    a longer list the splits are split0, split1 and so on; a dict is what it says."""
    if isinstance(shares, list | tuple):
        if len(shares) > 1:
            return {f"split{i}": x for i, x in enumerate(shares)}
        if not shares:
            raise ValueError("no shares")
        shares = shares[0]
    if isinstance(shares, dict):
        return shares
    if not 0 < shares < 1:
        raise ValueError("one share must be above 0 and below 1")
    return {"train": shares, "validation": (1 - shares) / 2, "test": (1 - shares) / 2}


def cluster_split(df: DataFrame, scope: list[str], key: list[str], shares: dict[str, float] | float | list[float] | None = None) -> DataFrame:
    """Assigns whole clusters to splits, so that none is in two. Returns scope, key columns and split, one row a cluster.

    Clusters are ordered by key. Splits take their share of the rows in descending order of share; the last one takes the
    rest. ``shares`` as ``named_shares`` takes them. Rows with a null key belong to no split but count among the rows. Only cluster sizes are ordered, by ranges."""
    shares = {"train": 0.8, "validation": 0.1, "test": 0.1} if shares is None else named_shares(shares)
    if abs(sum(shares.values()) - 1) > 1e-9:
        raise ValueError("shares must add up to 1")
    order = sorted(shares, key=lambda s: -shares[s])
    one = [F.lit("").alias("_scope")] if not scope else []
    by = scope or ["_scope"]
    rows = df.select("*", *one)
    known = F.lit(True)
    for c in key:
        known = known & F.col(c).isNotNull()
    sizes = written(rows.groupBy(*by, *key).agg(F.count("*").alias("n")), "sizes")
    total = sizes.groupBy(*by).agg(F.sum("n").alias("rows"), F.count_if(known).alias("groups"))
    sizes = sizes.where(known).join(total, by).withColumn("k", F.struct(*key))
    done = None
    for i, name in enumerate(order):
        if i == len(order) - 1:
            part, sizes = sizes.withColumn("split", F.lit(name)), None
        else:
            cut = written(_cut(sizes, by, shares[name]), "cut")
            part, sizes = cut.where("taken").withColumn("split", F.lit(name)), cut.where("not taken").drop("taken")
        part = part.select(*scope, *key, "n", "split")
        done = part if done is None else done.union(part)
    return done


def level_splits(df: DataFrame, scope: list[str], levels: dict[str, list[str]] = LEVELS) -> DataFrame:
    """Splits at every identity level: scope, level, key (joined with dots), n, split."""
    out = None
    for name, key in levels.items():
        one = cluster_split(df, scope, key).select(*scope, F.lit(name).alias("level"), F.concat_ws(".", *key).alias("key"), "n", "split")
        out = one if out is None else out.union(one)
    return out


def _hashed_ranks(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """Adds ``_k``, the place of each row in its class (from 1) by the hash of its key. A class is ranked in 256 parts by how
    its hashes begin, and the parts' sizes are added."""
    h = df.withColumn("_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))).withColumn("_b", F.substring("_h", 1, 2))
    before = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = h.groupBy(label, "_b").count().select(label, "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy(label, "_b").orderBy("_h", key)
    return h.withColumn("_k", F.row_number().over(own)).join(base, [label, "_b"]).withColumn("_k", F.col("_k") + F.col("_base")).drop("_h", "_b", "_base")


def balance(df: DataFrame, label: str, key: str, seed: int = 0) -> DataFrame:
    """Undersamples every class to the smallest one, by order of a hash of the key."""
    least = df.groupBy(label).count().agg(F.min("count").alias("_least"))
    return _hashed_ranks(df, label, key, seed).crossJoin(F.broadcast(least)).where("_k <= _least").select(*df.columns)  # one row


#: Draws that one row stands for before they are made one by one.
DRAWS = 10_000


def oversample(df: DataFrame, label: str, key: str, seed: int = 0) -> DataFrame:
    """Keeps all rows and draws further ones with replacement, by hash, up to the largest class. Draws are made in blocks, so
    that those of a class come from many tasks."""
    counts = df.groupBy(label).count()
    most = counts.agg(F.max("count").alias("most"))
    short = counts.crossJoin(F.broadcast(most)).where(F.col("count") < F.col("most"))  # one row
    blocks = short.select("*", F.explode(F.sequence(F.lit(0), F.expr(f"(most - count - 1) div {DRAWS}"))).alias("_block")).repartition(F.col(label), F.col("_block"))
    draws = blocks.select(label, "count", F.explode(F.sequence(F.col("_block") * DRAWS + 1, F.least((F.col("_block") + 1) * DRAWS, F.col("most") - F.col("count")))).alias("_d"))
    number = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(label).cast("string"), F.col("_d").cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")
    draws = draws.select(label, (number % F.col("count") + 1).alias("_k"))
    return df.unionByName(draws.join(_hashed_ranks(df, label, key, seed), [label, "_k"]).select(*df.columns))


def dataset_view(domains: DataFrame, names: list | None = None, representatives: DataFrame | None = None, splits: DataFrame | None = None, scope: tuple[str, ...] = ("cath_code",), key: tuple[str, ...] = ("s",), level: str | None = None, split: str | None = None) -> DataFrame:
    """The domains of a dataset: an explicit list, the representatives, the rows of a split at a level (``splits`` as
    ``level_splits`` gives them), or all. ``key``: the cluster columns of the level."""
    if names is not None:
        return domains.where(F.col("cath_domain").isin(list(names)))
    if representatives is not None:
        return domains.join(representatives.select("cath_domain").distinct(), "cath_domain", "left_semi")
    if splits is None:
        return domains
    mine = splits.where((F.col("level") == level) & (F.col("split") == split)).select(*scope, F.col("key").alias("_key"))
    return domains.withColumn("_key", F.concat_ws(".", *key)).join(mine, [*scope, "_key"], "left_semi").drop("_key")


def flat_splits(df: DataFrame, levels: dict[str, list[str]], representatives_at: str | None = None, name: str = "cath_domain") -> tuple[DataFrame, DataFrame | None]:
    """Splits over the whole table at every level (level, key, n, split), and the first domain of each cluster of one level."""
    reps = None
    if representatives_at:
        key = F.concat_ws(".", *levels[representatives_at])
        reps = df.groupBy(key.alias("key")).agg(F.min(name).alias("representative"))
    return level_splits(df, [], levels), reps


def chain_representatives(chains: DataFrame, entities: DataFrame, clusters: DataFrame) -> DataFrame:
    """Each chain's entity, the entity's cluster, and the chain that stands for the cluster: the first chain of its entity of
    the least rank. ``chains``: pdb, chain; ``entities``: pdb, chain, entity; ``clusters``: pdb, entity, cluster, rank. Returns pdb,
    chain, entity, cluster, representative_pdb, representative_chain, is_representative; what a chain has no entity or no
    cluster for is null, and it is no representative."""
    known = chains.select("pdb", "chain").distinct().join(entities.select("pdb", "chain", "entity").distinct(), ["pdb", "chain"], "left")
    placed = known.join(clusters.select("pdb", "entity", "cluster", "rank"), ["pdb", "entity"], "left")
    heads = placed.where("cluster is not null").groupBy("cluster").agg(F.min(F.struct("rank", "pdb", "entity", "chain")).alias("h"))
    out = placed.join(heads, "cluster", "left")
    own = (F.col("pdb") == F.col("h.pdb")) & (F.col("chain") == F.col("h.chain"))
    return out.select("pdb", "chain", "entity", "cluster", F.col("h.pdb").alias("representative_pdb"), F.col("h.chain").alias("representative_chain"), F.coalesce(own, F.lit(False)).alias("is_representative"))


def truth_from_list(rows: DataFrame, stored: DataFrame, by: str = "cath_domain", residue: str = "residue_id", listed: str = "residues", separator: str = ",") -> DataFrame:
    """Adds ``truth``: whether the row's residue is in the list that is stored for its structure. ``stored``: by and a text of
    residues with a separator (blanks round them don't count). Without a stored list nothing is true; several lists of a
    structure are one."""
    named = stored.select(by, F.explode(F.split(listed, separator)).alias("_r")).select(by, F.trim("_r").alias(residue)).distinct().withColumn("truth", F.lit(True))
    return rows.join(named.where(F.col(residue) != ""), [by, residue], "left").withColumn("truth", F.coalesce("truth", F.lit(False)))


def natural_key(text: str) -> Column:
    """What a text with one number sorts by: (prefix, number, suffix), blanks in prefix and suffix made single and cut at the
    ends, the sign of the number left out. Null if the text has no number, or several."""
    number = r"[+-]?([0-9]+(?:[.][0-9]*)?|[.][0-9]+)"
    parts = F.split(F.col(text).cast("string"), number)
    tidy = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    value = F.regexp_extract(F.col(text).cast("string"), number, 1).cast("double")
    return F.when(F.size(parts) == 2, F.struct(tidy(parts[0]).alias("prefix"), value.alias("number"), tidy(parts[1]).alias("suffix")))


def attach_domains(domains: DataFrame, nodes: DataFrame | None = None, code: str = "cath_code", length: str = "domain_length") -> DataFrame:
    """For each family how many domains it has, and the shortest and longest; with ``nodes``, also families without any."""
    found = domains.groupBy(code).agg(F.count("*").alias("n"), F.min(length).alias("shortest"), F.max(length).alias("longest"))
    return found if nodes is None else nodes.join(found, code, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def top_families(df: DataFrame, k: int = 300, code: str = "cath_code") -> DataFrame:
    """The ``k`` families of most rows, by name where they are alike."""
    return df.groupBy(code).agg(F.count("*").alias("n")).orderBy(F.desc("n"), code).limit(k)


def concatenate(parts: dict[str, DataFrame], name: str = "part") -> DataFrame:
    """Datasets one after the other, each row with the name of its own; columns that one lacks are null there."""
    if not parts:
        raise ValueError("nothing to concatenate")
    out = None
    for n, df in parts.items():
        one = df.withColumn(name, F.lit(n))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def common_keys(requested: DataFrame, existing: DataFrame, key: str = "cath_domain") -> DataFrame:
    """The different keys that both tables have; null is no key."""
    return requested.select(key).where(F.col(key).isNotNull()).intersect(existing.select(key))


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys that only the left or only the right has (nulls are equal), and whether there are none."""
    one = lambda df, n: df.select(*keys).distinct().withColumn("side", F.lit(n))
    both = one(left, "l").unionByName(one(right, "r")).groupBy(*keys).agg(F.count("*").alias("n"), F.min("side").alias("side"))
    alone = lambda n: F.count_if((F.col("n") == 1) & (F.col("side") == n))
    return both.agg(alone("l").alias("only_left"), alone("r").alias("only_right")).withColumn("same", F.col("only_left") + F.col("only_right") == 0)


def drop_negatives(df: DataFrame, truth: Column) -> DataFrame:
    """The rows that are true; an unknown truth is none."""
    return df.where(F.coalesce(truth, F.lit(False)))


def search_union(df: DataFrame, searches: list[Column], key: str = "cath_domain") -> DataFrame:
    """The different keys that any of the searches finds, in one scan."""
    found = F.lit(False)
    for s in searches:
        found = found | F.coalesce(s, F.lit(False))
    return df.where(found).select(key).distinct()


def places(df: DataFrame, by: list[str], order: list[str], name: str = "place") -> DataFrame:
    """Adds the place of each row in its group, from 1, by an order; groups are as large as a task may sort."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
