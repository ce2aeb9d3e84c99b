"""Queries over fixed draws, files and inline trees: what random or file-based operators compute, with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repseq.functions.constants import IUPAC_AA, IUPAC_DNA, aa_matrix, dna_matrix
from repseq.operators import diversity as D
from repseq.operators.clones import count_clones
from repseq.operators.lineage import phylip_input
from repseq.plans.fixtures import WITH_AIRR, airr
from repseq.plans.registry import Registry
from repseq.session import shared_dir
from repseq.sources import fastq, tables, trees

REGISTRY = Registry()
_Z = 1.959963984540054


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" and c != "q" else F.col(c) for c, t in df.dtypes))


# Diversity from fixed realisations ------------------------------------------------------------------------------------------
def _fixed_boot(spark: SparkSession, d: str) -> D.AbundanceCurve:
    """Four realisations: a clone's count times 1 to 3, by its name's length and the round, as shares of the sample."""
    c = count_clones(airr(spark, d).drop("cell_id"), "sample_id").select("sample_id", "clone_id", F.col("seq_count").cast("double").alias("x"))
    each = c.withColumns({f"w{i}": F.col("x") * (1 + (F.length("clone_id") + F.col("x") + i) % 3) for i in range(4)})
    total = each.groupBy("sample_id").agg(*(F.sum(f"w{i}").alias(f"t{i}") for i in range(4)))
    boot = each.join(total, "sample_id").select("sample_id", "clone_id", F.array(*(F.col(f"w{i}") / F.col(f"t{i}") for i in range(4))).alias("boot"))
    return D.abundance_curve(boot, "sample_id", "clone_id", nboot=4)


_BOOT = f"""{WITH_AIRR}, c AS (SELECT sample_id, clone_id, CAST(count(*) AS DOUBLE) AS x FROM airr WHERE clone_id IS NOT NULL GROUP BY ALL), it AS (SELECT unnest(range(0, 4)) AS iter),
  b AS (SELECT sample_id, clone_id, iter, w / sum(w) OVER (PARTITION BY sample_id, iter) AS p FROM (SELECT *, x * (1 + (length(clone_id) + CAST(x AS BIGINT) + iter) % 3) AS w FROM c, it))"""
_ORDERS = """, o AS (SELECT q, CASE WHEN q = 1 THEN 0.9999::DOUBLE ELSE q END AS o FROM (SELECT CAST(unnest([0.0, 1.0, 2.0, 3.0, 4.0]) AS DOUBLE) AS q)),
  i AS (SELECT sample_id, iter, q, pow(sum(pow(p, o)), 1 / (1 - any_value(o))) AS d FROM b, o GROUP BY ALL)"""
REGISTRY.add(
    "abundance_fixed",
    lambda spark, d: _rounded(_fixed_boot(spark, d).abundance, 9),
    f"""{_BOOT}, m AS (SELECT sample_id, clone_id, avg(p) AS p, stddev_samp(p) AS s, list(p ORDER BY iter) AS l FROM b GROUP BY ALL),
    e AS (SELECT *, (((0.0::DOUBLE + l[1]) + l[2]) + l[3] + l[4]) / 4 AS mean FROM m)
    SELECT sample_id, clone_id, round(mean, 9) AS p, round(s, 9) AS p_sd, round(greatest(0, mean - {_Z} * s), 9) AS lower, round(mean + {_Z} * s, 9) AS upper,
      CAST(row_number() OVER (PARTITION BY sample_id ORDER BY mean DESC, clone_id) AS INTEGER) AS rank FROM e""",
)
REGISTRY.add(
    "alpha_diversity_fixed",
    lambda spark, d: _rounded(D.alpha_diversity(_fixed_boot(spark, d), step_q=1).diversity, 4),
    f"""{_BOOT}{_ORDERS}, s AS (SELECT sample_id, q, avg(d) AS d, stddev_samp(d) AS d_sd FROM i GROUP BY ALL),
    t AS (SELECT *, greatest(0, d - {_Z} * d_sd) AS d_lower, d + {_Z} * d_sd AS d_upper, max(d) FILTER (q = 0) OVER (PARTITION BY sample_id) AS r FROM s)
    SELECT sample_id, q, round(d, 4) AS d, round(d_sd, 4) AS d_sd, round(d_lower, 4) AS d_lower, round(d_upper, 4) AS d_upper, round(d / r, 4) AS e, round(d_lower / r, 4) AS e_lower, round(d_upper / r, 4) AS e_upper FROM t""",
)
REGISTRY.add(
    "alpha_tests_fixed",
    lambda spark, d: _rounded(D.alpha_diversity(_fixed_boot(spark, d), min_q=2, step_q=1).tests.where("q > 0"), 4),
    f"""{_BOOT}{_ORDERS}, p AS (SELECT a.sample_id || ' != ' || b.sample_id AS test, a.q, a.d - b.d AS delta FROM i a JOIN i b ON a.iter = b.iter AND a.q = b.q AND a.sample_id < b.sample_id WHERE a.q >= 2),
    t AS (SELECT test, q, avg(delta) AS m, stddev_samp(delta) AS sd, CASE WHEN avg(delta) >= 0 THEN avg(CASE WHEN delta <= 0 THEN 1.0 ELSE 0.0 END) ELSE avg(CASE WHEN delta >= 0 THEN 1.0 ELSE 0.0 END) END AS p0 FROM p GROUP BY ALL)
    SELECT test, q, round(abs(m), 4) AS delta_mean, round(sd, 4) AS delta_sd, round(CASE WHEN p0 <= 0.5 THEN 2 * p0 ELSE 2 * (1 - p0) END, 4) AS pvalue FROM t""",
)
REGISTRY.add(
    "beta_diversity_fixed",
    lambda spark, d: _rounded(D.beta_diversity(_fixed_boot(spark, d), {"F-O": ["F", "O"], "all": ["F", "O", "P"]}, min_q=0, step_q=2), 5),
    f"""{_BOOT}{_ORDERS}, k AS (SELECT unnest([{{'n': 'F-O', 's': 'F'}}, {{'n': 'F-O', 's': 'O'}}, {{'n': 'all', 's': 'F'}}, {{'n': 'all', 's': 'O'}}, {{'n': 'all', 's': 'P'}}]) AS k),
    a AS (SELECT k.n AS comparison, iter, q, avg(d) AS alpha FROM i JOIN k ON k.s = sample_id GROUP BY ALL), g AS (SELECT k.n AS comparison, iter, clone_id, sum(p) AS p FROM b JOIN k ON k.s = sample_id GROUP BY ALL),
    h AS (SELECT comparison, iter, q, pow(sum(pow(p, o)) / pow(sum(p), any_value(o)), 1 / (1 - any_value(o))) AS gamma FROM g, o GROUP BY ALL),
    s AS (SELECT comparison, q, avg(gamma / alpha) AS d, stddev_samp(gamma / alpha) AS d_sd FROM a JOIN h USING (comparison, iter, q) WHERE q % 2 = 0 GROUP BY ALL)
    SELECT comparison, q, round(d, 5) AS d, round(d_sd, 5) AS d_sd, round(greatest(0, d - {_Z} * d_sd), 5) AS d_lower, round(d + {_Z} * d_sd, 5) AS d_upper, round(d / max(d) FILTER (q = 0) OVER (PARTITION BY comparison), 5) AS e FROM s""",
)


def _totals(spark: SparkSession, d: str) -> DataFrame:
    """How many sequences each realisation of the bootstrap holds: the smallest sample's, in whole counts."""
    curve = D.estimate_abundance(airr(spark, d).drop("cell_id"), group="sample_id", nboot=20)
    small = F.min("n").over(D.W.partitionBy(F.lit(0)))
    sizes = count_clones(airr(spark, d).drop("cell_id"), "sample_id").groupBy("sample_id").agg(F.sum("seq_count").alias("n")).select("sample_id", small.alias("size"))
    rows = curve.bootstrap.select("sample_id", F.posexplode("boot").alias("iter", "p")).join(sizes, "sample_id")
    whole = F.bool_and(F.abs(F.col("p") * F.col("size") - F.round(F.col("p") * F.col("size"))) < 1e-6)
    return rows.groupBy("sample_id", "iter").agg(F.round(F.sum(F.col("p") * F.col("size"))).cast("long").alias("sequences"), whole.alias("whole"))


REGISTRY.add(
    "bootstrap_totals",
    _totals,
    f"""{WITH_AIRR}, n AS (SELECT sample_id, count(*) AS n FROM airr WHERE clone_id IS NOT NULL GROUP BY 1)
    SELECT sample_id, CAST(unnest(range(0, 20)) AS INTEGER) AS iter, (SELECT min(n) FROM n) AS sequences, true AS whole FROM n WHERE n >= 30""",
)


def _old_names(spark: SparkSession, d: str) -> DataFrame:
    """Orders and samples of the deprecated entry points, and that they agree with the present one."""
    db = airr(spark, d).drop("cell_id")
    some = {"nboot": 10, "cell_id": None}
    new = D.alpha_diversity(db, group="sample_id", clone="clone_id", step_q=2, **some).diversity.select("sample_id", "q", F.col("d").alias("new"))
    old = D.rarefy_diversity(db, "sample_id", "clone_id", step_q=2, **some).diversity.select("sample_id", "q", F.col("d").alias("old"))
    one = D.test_diversity(db, 2, "sample_id", "clone_id", **some).diversity.where("q = 2").select("sample_id", "q", F.col("d").alias("one"))
    return new.join(old, ["sample_id", "q"]).join(one, ["sample_id", "q"], "left").select("sample_id", "q", (F.abs(F.col("new") - F.col("old")) < 1e-9).alias("same"), (F.abs(F.col("new") - F.col("one")) < 1e-9).alias("same_at_order"))


REGISTRY.add(
    "rarefy_and_test_diversity",
    _old_names,
    f"""{WITH_AIRR}, s AS (SELECT sample_id FROM airr WHERE clone_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 30)
    SELECT sample_id, q, true AS same, CASE WHEN q = 2 THEN true END AS same_at_order FROM s, (SELECT CAST(unnest([0, 2, 4]) AS DOUBLE) AS q)""",
)
#: Quantiles of the normal distribution at 0.9, 0.95 and 0.7.
_QUANTILES = "[1.2815515655446004::DOUBLE, 1.6448536269514722::DOUBLE, 0.5244005127080407::DOUBLE]"
REGISTRY.add(
    "stouffer_meta_sql",
    lambda spark, d: _rounded(spark.createDataFrame([("even", *D.stouffer_meta([0.1, 0.05, 0.3])), ("weighted", *D.stouffer_meta([0.1, 0.05, 0.3], [5, 3, 1]))], "weights string, z double, pvalue double")),
    f"""WITH w AS (SELECT 'even' AS weights, [1.0::DOUBLE, 1.0, 1.0] AS w UNION ALL SELECT 'weighted', [5.0::DOUBLE, 3.0, 1.0]),
    z AS (SELECT weights, list_dot_product(w, {_QUANTILES}) / sqrt(list_dot_product(w, w)) AS z FROM w),
    k AS (SELECT weights, z, unnest(range(0, 40)) AS k FROM z)
    SELECT weights, round(z, 6) AS z, round(0.5 - sum(CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END * exp((2 * k + 1) * ln(z) - lgamma(k + 1) - k * ln(2.0)) / (2 * k + 1)) / sqrt(2 * pi()), 6) AS pvalue FROM k GROUP BY weights, z""",
)


# Files: written to the shared folder and read again ---------------------------------------------------------------------------
def _folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


_COLUMNS = ["sequence_id", "sample_id", "c_call", "locus", "v_call", "j_call", "clone_id", "cell_id", "junction", "sequence_alignment"]


def _airr_file(spark: SparkSession, d: str) -> DataFrame:
    df = airr(spark, d).select(*_COLUMNS, "duplicate_count", F.length("junction").alias("junction_length"), (F.col("duplicate_count") > 4).alias("productive"), (F.col("duplicate_count") / 8).alias("v_score"))
    path = _folder(spark, "airr")
    tables.write_airr(df, path)
    return tables.read_airr(spark, path)


REGISTRY.add("airr_file", _airr_file, f"{WITH_AIRR} SELECT {', '.join(_COLUMNS)}, duplicate_count, CAST(length(junction) AS BIGINT) AS junction_length, duplicate_count > 4 AS productive, CAST(duplicate_count / 8 AS DOUBLE) AS v_score FROM airr")


def _legacy_file(spark: SparkSession, d: str) -> DataFrame:
    df = airr(spark, d).select(F.col("sequence_id").alias("SEQUENCE_ID"), F.col("v_call").alias("V_CALL"), F.lower("junction").alias("JUNCTION"), F.col("duplicate_count").alias("DUPCOUNT"), (F.col("duplicate_count") > 4).alias("FUNCTIONAL"), F.col("clone_id").alias("CLONE"), F.col("sample_id").alias("SAMPLE"))
    path = _folder(spark, "legacy")
    tables.write_legacy(df, path)
    return tables.read_legacy(spark, path, drop=["SAMPLE"])


REGISTRY.add("legacy_file", _legacy_file, f'{WITH_AIRR} SELECT sequence_id AS "SEQUENCE_ID", v_call AS "V_CALL", upper(junction) AS "JUNCTION", duplicate_count AS "DUPCOUNT", duplicate_count > 4 AS "FUNCTIONAL", clone_id AS "CLONE" FROM airr')


def _fastq_file(spark: SparkSession, d: str) -> DataFrame:
    n = F.substring("sequence_id", 2, 8).cast("int")
    codes = F.transform(F.sequence(F.lit(1), F.length("junction")), lambda i: F.char((n + 7 * i) % 41 + 33))
    lines = F.array(F.concat(F.lit("@"), "sequence_id", F.lit("|PRCONS=x")), F.col("junction"), F.lit("+"), F.array_join(codes, ""))
    path = _folder(spark, "fastq")
    airr(spark, d).select(F.array_join(lines, "\n").alias("value")).write.text(path)
    return fastq.read_fastq(spark, path)


REGISTRY.add(
    "fastq_file",
    _fastq_file,
    f"""{WITH_AIRR}, x AS (SELECT sequence_id, junction, CAST(substr(sequence_id, 2, 8) AS INT) AS n FROM airr), p AS (SELECT *, unnest(range(1, length(junction) + 1)) AS i FROM x)
    SELECT sequence_id, any_value(junction) AS sequence, string_agg(chr(CAST((n + 7 * i) % 41 + 33 AS INT)), '' ORDER BY i) AS quality, string_agg(CAST((n + 7 * i) % 41 AS VARCHAR), ',' ORDER BY i) AS quality_num FROM p GROUP BY 1""",
)


# Trees: a caterpillar per repertoire, whose rows SQL can state ------------------------------------------------------------------
def _codon_file(spark: SparkSession, d: str, name: str = "codon") -> str:
    """One tree of a nation's number of tips plus two, as a table of codon-model trees: ``((t1:.01,t2:.02)...,<clone>_GERM:0)``."""
    n = spark.read.parquet(f"{d}/nation.parquet")
    size = (F.col("n_nationkey") % 4 + 2).cast("int")
    tip = lambda i: F.concat(F.lit("t"), i.cast("string"), F.lit(":0.0"), (i % 9 + 1).cast("string"))
    first = F.concat(F.lit("("), tip(F.lit(1)), F.lit(","), tip(F.lit(2)), F.lit(")"))
    body = F.aggregate(F.sequence(F.lit(3), size + 1), first, lambda s, i: F.concat(F.lit("("), s, F.lit(":0.05,"), tip(i), F.lit(")")))
    tree = F.concat(F.lit("("), body, F.lit(":0.1,"), F.col("n_nationkey").cast("string"), F.lit("_GERM:0.0);"))
    rows = n.select(F.col("n_nationkey").cast("string").alias("CLONE"), F.lit("100").alias("NSITE"), F.lit("1.5").alias("OMEGA_FWR_MLE"), tree.alias("TREE"))
    rows = spark.createDataFrame([("REPERTOIRE", "NA", "0.4", f"command {name}")], rows.schema).union(rows)
    path = _folder(spark, "codon")
    rows.coalesce(1).write.csv(path, sep="\t", header=True, quote="", escape="")
    return path


def _codon_tips(spark: SparkSession, d: str) -> DataFrame:
    run = trees.read_codon_trees(spark, _codon_file(spark, d), id="A")
    return run.edges.where(F.col("child").rlike("^t")).select("tree_id", "child", F.round("weight", 6).alias("weight"))


_TIPS = "SELECT n_nationkey AS k, CAST(unnest(range(1, CAST(n_nationkey % 4 + 4 AS BIGINT))) AS BIGINT) AS i FROM nation"
REGISTRY.add("codon_trees", _codon_tips, f"SELECT CAST(k AS VARCHAR) AS tree_id, 't' || CAST(i AS VARCHAR) AS child, CAST(i % 9 + 1 AS DOUBLE) AS weight FROM ({_TIPS}) WHERE i <= k % 4 + 3")
REGISTRY.add(
    "combine_codon_runs",
    lambda spark, d: trees.combine_codon_runs([trees.read_codon_trees(spark, _codon_file(spark, d, x), id=x) for x in ("A", "B")], "long"),
    "SELECT unnest(['A', 'B']) AS id, 'omega_fwr_mle' AS variable, '0.4' AS value UNION ALL SELECT unnest(['A', 'B']), 'nsite', NULL",
)


def _rerooted(spark: SparkSession, d: str) -> DataFrame:
    """Trees with the germline moved to a branch of length 0 at the root: its tips and their lengths."""

    def move(batches):
        for pdf in batches:
            out = []
            for (k,) in pdf.itertuples(index=False):
                root = trees.reroot_germline(trees.parse_newick(f"(g{k}:0.{k % 9 + 1},(a:0.1,b:0.2)n:0.3);"), f"g{k}")
                for x in trees.walk(root):
                    out += [(k, x.name, c.name, round(c.length, 6)) for c in x.children if c.name]
            yield pdf.__class__(out, columns=["tree_id", "parent", "child", "length"])

    found = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("k")).mapInPandas(move, "tree_id long, parent string, child string, length double")
    return found.where("child != 'n'").select("tree_id", "child", "length")


REGISTRY.add(
    "reroot_germline",
    _rerooted,
    "SELECT CAST(n_nationkey AS BIGINT) AS tree_id, unnest(['g' || CAST(n_nationkey AS VARCHAR), 'a', 'b']) AS child, unnest([0.0::DOUBLE, 0.1, 0.2]) AS length FROM nation",
)


def _forest(spark: SparkSession, d: str) -> DataFrame:
    """Lineage graphs: under the germline a root, under it as many leaves as the nation's number says."""
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("tree_id"))
    leaves = n.select("tree_id", F.lit("r").alias("parent"), F.explode(F.sequence(F.lit(1), (F.col("tree_id") % 3 + 2).cast("int"))).alias("i"))
    leaves = leaves.select("tree_id", "parent", F.concat(F.lit("x"), F.col("i").cast("string")).alias("child"), F.col("i").cast("double").alias("weight"))
    return leaves.union(n.select("tree_id", F.lit("Germline"), F.lit("r"), F.lit(2.0)))


_LEAVES = "SELECT CAST(n_nationkey AS BIGINT) AS tree_id, CAST(unnest(range(1, CAST(n_nationkey % 3 + 3 AS BIGINT))) AS BIGINT) AS i FROM nation"
REGISTRY.add(
    "phylo_tips",
    lambda spark, d: trees.graph_to_phylo(_forest(spark, d)).where("name LIKE 'x%'").select("tree_id", "name", "weight"),
    f"SELECT tree_id, 'x' || CAST(i AS VARCHAR) AS name, CAST(i AS DOUBLE) AS weight FROM ({_LEAVES}) WHERE i <= tree_id % 3 + 2",
)
REGISTRY.add(
    "graph_round_trip",
    lambda spark, d: trees.phylo_to_graph(trees.graph_to_phylo(_forest(spark, d))).where("child LIKE 'x%'").select("tree_id", "child", "weight"),
    f"SELECT tree_id, 'x' || CAST(i AS VARCHAR) AS child, CAST(i AS DOUBLE) AS weight FROM ({_LEAVES}) WHERE i <= tree_id % 3 + 2",
)


# Formats and tables of values -----------------------------------------------------------------------------------------------------
def _phylip(spark: SparkSession, d: str) -> DataFrame:
    """The input file for every nation's two sequences under a germline."""
    rows = []
    for (k,) in spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long")).collect():  # 25 nations
        text, taxa = phylip_input("ACGT" * (k % 3 + 1), {f"s{k}": "ACGA" * (k % 3 + 1), f"t{k}": "CCGA" * (k % 3 + 1)})
        lines = text.splitlines()
        rows += [(k, i, " ".join(x.split())) for i, x in enumerate(lines)] + [(k, 100 + len(taxa), ",".join(sorted(taxa.values())))]
    return spark.createDataFrame(rows, "tree_id long, line long, text string")


def _matrix(spark: SparkSession, values: dict[tuple[str, str], float]) -> DataFrame:
    return spark.createDataFrame([(a, b, float(v)) for (a, b), v in values.items()], "a string, b string, distance double")


def _matrix_sql(codes: dict[str, str], gap: float, gap_to_gap: float, unknown: bool) -> str:
    """Codes as sets of letters: 0 where the sets share one; ``?`` equals itself only."""
    rows = ", ".join(f"('{c}', '{''.join(x)}', 0)" for c, x in [*codes.items(), *([("?", "")] if unknown else [])])
    return f"""WITH x AS (SELECT * FROM (VALUES {rows}, ('-', '', 1), ('.', '', 1)) t(code, meant, gap))
      SELECT a.code AS a, b.code AS b, CAST(CASE WHEN a.code = '?' OR b.code = '?' THEN CASE WHEN a.code = b.code THEN 0 ELSE 1 END WHEN a.gap = 1 AND b.gap = 1 THEN {gap_to_gap} WHEN a.gap = 1 OR b.gap = 1 THEN {gap}
        WHEN len(list_intersect(string_split(a.meant, ''), string_split(b.meant, ''))) > 0 THEN 0 ELSE 1 END AS DOUBLE) AS distance FROM x a, x b"""


REGISTRY.add(
    "phylip_input",
    _phylip,
    """WITH n AS (SELECT CAST(n_nationkey AS BIGINT) AS k, n_nationkey % 3 + 1 AS r FROM nation)
    SELECT k AS tree_id, 0::BIGINT AS line, '3 ' || CAST(CAST(4 * r AS BIGINT) AS VARCHAR) AS text FROM n UNION ALL SELECT k, 1, 'Germline ' || repeat('ACGT', CAST(r AS BIGINT)) FROM n
    UNION ALL SELECT k, 2, 'SAM1 ' || repeat('ACGA', CAST(r AS BIGINT)) FROM n UNION ALL SELECT k, 3, 'SAM2 ' || repeat('CCGA', CAST(r AS BIGINT)) FROM n
    UNION ALL SELECT k, 102, 's' || CAST(k AS VARCHAR) || ',t' || CAST(k AS VARCHAR) FROM n""",
)
REGISTRY.add("aa_matrix", lambda spark, d: _matrix(spark, aa_matrix()), _matrix_sql(IUPAC_AA, 0, 0, False))
REGISTRY.add("dna_matrix", lambda spark, d: _matrix(spark, dna_matrix()), _matrix_sql(IUPAC_DNA, -1, 0, True))
