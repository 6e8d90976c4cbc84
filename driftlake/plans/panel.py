"""Queries over the relational tables, which stand in for genomes (customer), proteins (orders) and family hits (lineitem, part).

nation is the phylum, region the domain; a hit's family is `PF` and the part's
key modulo 1000, versioned by its size; T0 are the hits shipped before a date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vectors import as_doubles, rounded
from ..operators import device, embedders, labeling, sampling, separation, transfer
from ..session import table
from ..sources import tables as src

T0, DONE = "1996-06-01", "1992-06-01"
SEED = 42


def genomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """accession, phylum, domain, flag."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    flag = F.when(F.col("c_acctbal") > 0, "t").otherwise("f")
    return table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("accession"), F.col("n_name").alias("phylum"), F.col("r_name").alias("domain"), "c_mktsegment", flag.alias("gtdb_representative"))


def lineages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """accession, source, lineage: some lack a genus, some repeat the phylum."""
    g = genomes(spark, sf_dir)
    genus = F.when(F.col("accession") % 7 == 0, "g__").otherwise(F.concat(F.lit("g__"), F.col("c_mktsegment")))
    again = F.when(F.col("accession") % 11 == 0, ";p__again__twice").otherwise("")
    lineage = F.concat(F.lit("d__"), "domain", F.lit(";p__"), "phylum", F.lit(";x__odd; c__spaced;"), genus, again)
    return g.select("accession", F.when(F.col("domain") == "ASIA", "ar").otherwise("bac").alias("source"), lineage.alias("lineage"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """protein_id, family (versioned), at_t0."""
    family = F.concat(F.lit("PF"), F.lpad((F.col("l_partkey") % 1000).cast("string"), 5, "0"), F.lit("."), F.col("p_size").cast("string"))
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("l_orderkey").alias("protein_id"), family.alias("family"), (F.col("l_shipdate") < F.lit(T0).cast("timestamp")).alias("at_t0"))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Proteins, hits at T0, hits at T1, families new at T1. The older library knows three in four families."""
    h = hits(spark, sf_dir)
    old = F.substring("family", 3, 5).cast("int") % 4 != 0
    then = h.where(F.col("at_t0") & old)
    bare = lambda rows: rows.select(tx.strip_version(F.col("family")).alias("family"))
    proteins = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("protein_id"), F.col("o_custkey").alias("genome"))
    return proteins, then, h, labeling.new_families(bare(then), bare(h))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labeling.snapshot_labels(*snapshots(spark, sf_dir))


def lineage_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1, S1, S2."""
    return src.parse_lineages(lineages(spark, sf_dir))


def taxonomy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: an empty rank counts as a value."""
    t = src.parse_lineages(lineages(spark, sf_dir))
    return t.agg(F.count("*").alias("total"), F.count_if(F.col("source") == "bac").alias("bacteria"), F.count_if(F.col("source") == "ar").alias("archaea"), F.countDistinct("phylum").alias("phyla"), F.countDistinct("genus").alias("genera"), F.countDistinct("species").alias("species"), F.count_if(F.col("species") == "").alias("no_species"))


def panel_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1, A2, F1, F2: sizes by phylum."""
    g = genomes(spark, sf_dir)
    return sampling.panel(g, src.representatives(g), 200, 2, 10, SEED)[1].select("phylum", "size", F.col("fraction").alias("f"))


def representative_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2, J2, W4."""
    g = genomes(spark, sf_dir)
    return sampling.panel(g, src.representatives(g), 200, 2, 10, SEED)[0].select("accession", "phylum")


def new_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3, U3, U4, P2."""
    return snapshots(spark, sf_dir)[3]


def snapshot_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4-J6, P9."""
    return labels(spark, sf_dir)


def label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3, P18."""
    return labeling.summary(labels(spark, sf_dir)).select("n", "n_dark", "n_characterised", "n_positive", *[rounded(F.col(c)).alias(c) for c in ("pct_dark", "pct_positive")])


def go_no_go(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P19."""
    return labeling.go_no_go(labels(spark, sf_dir))


def hit_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty lists stay."""
    proteins, then, _, _ = snapshots(spark, sf_dir)
    return labeling.hit_lists(proteins, then).select("protein_id", "n_hits", F.array_join("families", ",").alias("families"))


def included_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hits at or above their family's threshold."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).where(F.col("l_quantity") >= F.col("p_size"))
    return rows.groupBy("p_brand").agg(F.count("*").alias("included"))


def _sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = genomes(spark, sf_dir).select(F.col("accession").alias("genome"), F.col("phylum").alias("stratum"))
    return sampling.embedding_sample(labels(spark, sf_dir), groups, 1000, 1500, SEED)


def embedding_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3, Q4, Q7, J1, F3, P7, P8, U1."""
    return _sample(spark, sf_dir)


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4."""
    return _sample(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"))


def diverse_genome_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5."""
    return sampling.stratified_at_most(genomes(spark, sf_dir), 60, SEED, "accession", "phylum").select("accession", "phylum")


def family_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q8: families by size class, at most a third each."""
    sizes = separation.single_family_members(hits(spark, sf_dir)).groupBy("family").agg(F.count("*").alias("n"))
    binned = sizes.withColumn("size_class", F.when(F.col("n") < 2, "a").when(F.col("n") < 4, "b").otherwise("c"))
    return sampling.stratified_at_most(binned, 50, SEED, "family", "size_class").select("family", "size_class", "n")


def matched_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J17."""
    rows = labels(spark, sf_dir).join(genomes(spark, sf_dir), F.col("genome") == F.col("accession")).select(F.col("protein_id").alias("id"), "phylum", (F.col("protein_id") % 5).alias("length_bin"), "positive", "dark")
    return sampling.matched_controls(rows.where("positive"), rows.where("not dark"), ["phylum", "length_bin"], SEED)


def labeled_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8, F9, A17, W2, W3."""
    return separation.labeled_subset(hits(spark, sf_dir).select("protein_id", tx.strip_version(F.col("family")).alias("family")), 3, 4, 20)


def heldout_family_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16."""
    return separation.largest_family(hits(spark, sf_dir).select("protein_id", tx.strip_version(F.col("family")).alias("family")), 3)


def protein_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled proteins with role, family, phylum and length, up to 1024."""
    length = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("protein_id"), (F.col("o_custkey") % 1500).alias("length_aa"))
    single = separation.single_family_members(hits(spark, sf_dir)).select(F.col("member").alias("protein_id"), F.col("family").alias("pfam_family"))
    groups = genomes(spark, sf_dir).select(F.col("accession").alias("genome"), "phylum")
    rows = _sample(spark, sf_dir).join(length, "protein_id").where("length_aa <= 1024").join(single, "protein_id", "left").join(groups, "genome", "left")
    role = F.when(F.col("category") == "characterised_at_t0", "reference").otherwise("query")
    return rows.select("protein_id", role.alias("role"), (F.col("category") == "positive").alias("is_positive"), "pfam_family", "phylum", "length_aa")


def first_seen_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """positives whose first hit is after a cut-off."""
    first = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("protein_id")).agg(F.min("l_shipdate").alias("first_seen"))
    return labels(spark, sf_dir).where("positive").join(first.where(F.col("first_seen") > F.lit("1997-01-01").cast("timestamp")), "protein_id").select("protein_id", "genome")


def masked_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over texts whose runs of `n` are stretched."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.mask_ambiguous(F.regexp_replace(F.substring("text", 1, 1 << 30), "nd", "nnnn")).cast("binary")).alias("masked_md5"))


def truncation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P15, F11."""
    rows = []
    for model, most in (("esm2", 1024), ("genos-m", 8192)):
        cut = table(spark, sf_dir, "documents").select(F.char_length("text").alias("n"), F.char_length(tx.truncate(F.col("text"), most)).alias("kept"))
        rows.append(cut.agg(F.lit(model).alias("model"), F.count_if(F.col("n") > F.col("kept")).alias("truncated"), F.sum("kept").alias("kept"), F.sum("n").alias("total")))
    return rows[0].unionByName(rows[1])


def name_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2, P4, S10, S11, S19, P20 on names built from keys."""
    n = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("s"))
    ending = F.when(F.col("c_custkey") % 3 == 0, ".txt").otherwise("_protein.faa")
    member = F.concat(F.lit("dir/sub/GB_"), "s", ending)
    header = F.concat(F.lit(">P"), "s", F.lit(" a > b"))
    return n.select("c_custkey", tx.member_key(member, "_protein.faa").alias("member"), tx.header_id(header).alias("header"), tx.remove_suffix(F.concat("s", ending), "_protein.faa").alias("stem"), tx.release_number(F.concat(F.lit("R"), "s")).alias("release"), tx.strip_version(F.concat(F.lit("PF"), "s", F.lit(".1.2"))).alias("bare"), tx.retry_wait(F.col("c_custkey") % 10).alias("wait"))


def remaining_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genomes of which no protein was done before a date."""
    g = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("genome"))
    done = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit(DONE).cast("timestamp")).select(F.col("o_custkey").alias("genome"))
    return labeling.remaining(g, done, "genome")


def missing_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W8, W9."""
    g = table(spark, sf_dir, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("genome"))
    done = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit(DONE).cast("timestamp")).select(F.lpad(F.col("o_custkey").cast("string"), 9, "0").alias("genome"))
    return labeling.missing_preview(labeling.remaining(g, done, "genome"), "genome")


def byte_range_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9: from where an earlier run stopped."""
    done = (F.col("doc_id") % 3) * 100
    files = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("total"), F.least(done, F.col("n_chars")).alias("done"), (F.col("doc_id") % 3 + 1).alias("next_part"))
    return transfer.byte_ranges(files, 500).select("doc_id", "part_number", "start", "end")


def byte_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5 over sizes from bytes to gigabytes."""
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.shown_bytes(F.col("o_orderkey") * F.lit(200_000.0)).alias("shown"))


def resume_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as its parts."""
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("upload"), F.col("l_linenumber").cast("long").alias("part_number"), F.col("l_quantity").cast("long").alias("size"))
    return transfer.resume_points(parts, "upload")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", F.floor(F.coalesce("value", F.lit(0.0)) * 100).cast("double").alias("size"))


def progress_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate between events."""
    return transfer.progress(_events(spark, sf_dir).withColumn("total", F.lit(1e6)), "user_id", "ts", "size", "total").select("event_id", rounded(F.col("done"), 3).alias("done"), rounded(F.col("rate"), 4).alias("rate"), rounded(F.col("percent"), 4).alias("percent"))


def progress_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports, each more than an hour after the last."""
    return transfer.reports(_events(spark, sf_dir), "user_id", "ts", "size", 3600.0).select("user_id", "report", rounded(F.col("done"), 3).alias("done"), rounded(F.col("rate"), 5).alias("rate"))


def device_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X8 over a grid."""
    grid = spark.createDataFrame([(d, g, q) for d in ("cuda", "mps", "cpu") for g in (8.0, 16.0, 24.0) for q in (0.0, 16.0)], "device string, total_gb double, quantize_below_gb double")
    return grid.select("*", F.coalesce(device.bits(F.col("device"), F.col("total_gb"), F.col("quantize_below_gb")), F.lit(0)).cast("long").alias("quantize_bits"), device.dtype(F.col("device")).alias("dtype"))


def embedded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1-X3 with the stand-in embedder, masked first, whole texts."""
    rows = embedders.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), "masked-kmers", "text")
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    v = as_doubles(F.col("embedding"))
    return rows.select("doc_id", F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("filled"), rounded(total(F.transform(v, lambda x, i: x * (i + 1))), 4).alias("weighted"), rounded(total(F.transform(v, lambda x: F.abs(x))), 4).alias("absolute"))


QUERIES = {f.__name__: f for f in (
    lineage_parse, taxonomy_summary, panel_allocation, representative_panel, new_families, snapshot_labels, label_summary, go_no_go, hit_lists, included_hits,
    embedding_sample, category_counts, diverse_genome_sample, family_sample, matched_controls, labeled_subset, heldout_family_pick, protein_table,
    first_seen_window, masked_sequences, truncation_report, name_parsing, remaining_work, missing_preview, byte_range_plan, byte_display, resume_offset, progress_rate,
    progress_reports, device_plan, embedded_documents,
)}

GENOMES = """
g AS (SELECT c_custkey AS accession, n_name AS phylum, r_name AS domain, c_mktsegment, CASE WHEN c_acctbal > 0 THEN 't' ELSE 'f' END AS rep
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
"""
LINEAGES = GENOMES + """
l AS (SELECT accession, CASE WHEN domain = 'ASIA' THEN 'ar' ELSE 'bac' END AS source,
             'd__' || domain || ';p__' || phylum || ';x__odd; c__spaced;' || CASE WHEN accession % 7 = 0 THEN 'g__' ELSE 'g__' || c_mktsegment END
             || CASE WHEN accession % 11 = 0 THEN ';p__again__twice' ELSE '' END AS lineage FROM g),
t AS (SELECT accession, source, """ + ", ".join(f"coalesce(substr(list_filter(string_split(lineage, ';'), lambda x: starts_with(x, '{p}__'))[-1], 4), '') AS {n}" if n != "order" else f"coalesce(substr(list_filter(string_split(lineage, ';'), lambda x: starts_with(x, '{p}__'))[-1], 4), '') AS \"order\"" for n, p in tx.RANKS.items()) + " FROM l),"
HITS = f"""
h AS (SELECT l_orderkey AS protein_id, 'PF' || lpad((l_partkey % 1000)::VARCHAR, 5, '0') || '.' || p_size AS family, l_partkey % 1000 AS num, l_shipdate < TIMESTAMP '{T0}' AS at_t0
      FROM lineitem JOIN part ON l_partkey = p_partkey),
h0 AS (SELECT * FROM h WHERE at_t0 AND num % 4 <> 0),
nf AS (SELECT DISTINCT split_part(family, '.', 1) AS family FROM h EXCEPT SELECT split_part(family, '.', 1) FROM h0),
"""
LABELS = HITS + """
lb AS (SELECT protein_id, genome, dark, characterised, dark AND characterised AS positive FROM (
         SELECT o_orderkey AS protein_id, o_custkey AS genome, o_orderkey NOT IN (SELECT protein_id FROM h0) AS dark,
                o_orderkey IN (SELECT protein_id FROM h WHERE split_part(family, '.', 1) IN (SELECT family FROM nf)) AS characterised FROM orders)),
"""
ALLOCATION = GENOMES + """
pc AS (SELECT phylum, count(DISTINCT accession) AS n FROM g WHERE rep = 't' GROUP BY phylum),
bs AS (
  WITH RECURSIVE step(i, lo, hi, f, total) AS (
    SELECT 1, 0.0::DOUBLE, 1.0::DOUBLE, 0.5::DOUBLE, (SELECT sum(least(n, greatest(2, least(10, round_even(0.5 * n, 0)))))::BIGINT FROM pc)
    UNION ALL
    SELECT i + 1, nlo, nhi, (nlo + nhi) / 2, (SELECT sum(least(n, greatest(2, least(10, round_even((nlo + nhi) / 2 * n, 0)))))::BIGINT FROM pc)
    FROM (SELECT i, CASE WHEN total < 200 THEN f ELSE lo END AS nlo, CASE WHEN total < 200 THEN hi ELSE f END AS nhi FROM step WHERE abs(total - 200) > 5 AND i < 60))
  SELECT f FROM step ORDER BY i DESC LIMIT 1),
al AS (SELECT phylum, CAST(least(n, greatest(2, least(10, round_even(f * n, 0)))) AS BIGINT) AS size, f FROM pc, bs),
"""
SAMPLE = LABELS + GENOMES + """
ps AS (SELECT genome, protein_id, 'positive' AS category FROM lb WHERE positive),
ng AS (SELECT genome, protein_id, 'dark_negative' AS category FROM lb WHERE dark AND NOT positive ORDER BY md5('42:' || protein_id), protein_id LIMIT 1000),
kn AS (SELECT lb.genome, protein_id, phylum FROM lb LEFT JOIN g ON genome = accession WHERE NOT dark),
kr AS (SELECT *, row_number() OVER (PARTITION BY phylum ORDER BY md5('42:' || protein_id), protein_id) AS rk FROM kn WHERE phylum IS NOT NULL),
kc AS (SELECT genome, protein_id, 'characterised_at_t0' AS category FROM kr WHERE rk <= (SELECT greatest(1, 1500 // greatest(1, count(DISTINCT phylum))) FROM kn) ORDER BY md5('42:' || protein_id), protein_id LIMIT 1500),
es AS (SELECT * FROM ps UNION ALL SELECT * FROM ng UNION ALL SELECT * FROM kc),
"""
SINGLE = """
sg AS (SELECT protein_id AS member, min({f}) AS family FROM h GROUP BY protein_id HAVING count(*) = 1),
"""
BARE, FULL_NAME = "split_part(family, '.', 1)", "family"


def _sql(parts: str, final: str) -> str:
    recursive = "RECURSIVE " if "RECURSIVE" in parts else ""
    return f"WITH {recursive}" + parts.strip().rstrip(",") + "\n" + final


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


EVENTS = "ev AS (SELECT event_id, ts, user_id, floor(coalesce(value, 0.0) * 100) AS size FROM events),"
ORACLES = {
    "lineage_parse": _sql(LINEAGES, "SELECT * FROM t"),
    "taxonomy_summary": _sql(LINEAGES, "SELECT count(*) AS total, count(*) FILTER (source = 'bac') AS bacteria, count(*) FILTER (source = 'ar') AS archaea, count(DISTINCT phylum) AS phyla, count(DISTINCT genus) AS genera, count(DISTINCT species) AS species, count(*) FILTER (species = '') AS no_species FROM t"),
    "panel_allocation": _sql(ALLOCATION, "SELECT phylum, size, f FROM al"),
    "representative_panel": _sql(ALLOCATION + "rk AS (SELECT accession, phylum, row_number() OVER (PARTITION BY phylum ORDER BY md5('42:' || accession), accession) AS rk FROM g WHERE rep = 't'),", "SELECT accession, phylum FROM rk JOIN al USING (phylum) WHERE rk <= size"),
    "new_families": _sql(HITS, "SELECT family FROM nf"),
    "snapshot_labels": _sql(LABELS, "SELECT * FROM lb"),
    "label_summary": _sql(LABELS, f"SELECT count(*) AS n, count(*) FILTER (dark) AS n_dark, count(*) FILTER (characterised) AS n_characterised, count(*) FILTER (positive) AS n_positive, {r('100.0 * count(*) FILTER (dark) / count(*)')} AS pct_dark, {r('100.0 * count(*) FILTER (positive) / count(*)')} AS pct_positive FROM lb"),
    "go_no_go": _sql(LABELS, "SELECT count(*) FILTER (positive) AS n_positive, CASE WHEN count(*) FILTER (positive) >= 50 THEN 'go' ELSE 'widen' END AS decision FROM lb"),
    "hit_lists": _sql(HITS, "SELECT o_orderkey AS protein_id, count(family) AS n_hits, coalesce(string_agg(family, ',' ORDER BY family), '') AS families FROM orders LEFT JOIN h0 ON o_orderkey = protein_id GROUP BY o_orderkey"),
    "included_hits": "SELECT p_brand, count(*) AS included FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= p_size GROUP BY p_brand",
    "embedding_sample": _sql(SAMPLE, "SELECT * FROM es"),
    "category_counts": _sql(SAMPLE, "SELECT category, count(*) AS n FROM es GROUP BY category"),
    "diverse_genome_sample": _sql(GENOMES + "rk AS (SELECT accession, phylum, row_number() OVER (PARTITION BY phylum ORDER BY md5('42:' || accession), accession) AS rk FROM g),", "SELECT accession, phylum FROM rk WHERE rk <= (SELECT greatest(1, 60 // count(DISTINCT phylum)) FROM g) ORDER BY md5('42:' || accession), accession LIMIT 60"),
    "family_sample": _sql(HITS + SINGLE.format(f=FULL_NAME) + "fs AS (SELECT family, count(*) AS n FROM sg GROUP BY family), fc AS (SELECT family, n, CASE WHEN n < 2 THEN 'a' WHEN n < 4 THEN 'b' ELSE 'c' END AS size_class FROM fs), rk AS (SELECT *, row_number() OVER (PARTITION BY size_class ORDER BY md5('42:' || family), family) AS rk FROM fc),", "SELECT family, size_class, n FROM rk WHERE rk <= (SELECT greatest(1, 50 // count(DISTINCT size_class)) FROM fc) ORDER BY md5('42:' || family), family LIMIT 50"),
    "matched_controls": _sql(LABELS + GENOMES + """
rw AS (SELECT protein_id AS id, phylum, protein_id % 5 AS length_bin, positive, dark FROM lb JOIN g ON genome = accession),
nv AS (SELECT *, row_number() OVER (PARTITION BY phylum, length_bin ORDER BY md5('42:' || id), id) AS rk FROM rw WHERE positive),
kw AS (SELECT *, row_number() OVER (PARTITION BY phylum, length_bin ORDER BY md5('42:' || id), id) AS rk FROM rw WHERE NOT dark),""", "SELECT nv.id AS novel_id, kw.id AS control_id, phylum, length_bin FROM nv JOIN kw USING (phylum, length_bin, rk)"),
    "labeled_subset": _sql(HITS + SINGLE.format(f=BARE) + "fs AS (SELECT family, count(*) AS n_members FROM sg GROUP BY family HAVING count(*) >= 3 ORDER BY count(*) DESC, min(member) LIMIT 20), rk AS (SELECT family, member, n_members, row_number() OVER (PARTITION BY family ORDER BY member) AS rank FROM sg JOIN fs USING (family)),", "SELECT * FROM rk WHERE rank <= 4"),
    "heldout_family_pick": _sql(HITS + SINGLE.format(f=BARE), "SELECT family, count(*) AS n_members FROM sg GROUP BY family HAVING count(*) >= 3 ORDER BY count(*) DESC, family LIMIT 1"),
    "protein_table": _sql(SAMPLE + SINGLE.format(f=FULL_NAME), "SELECT es.protein_id, CASE WHEN category = 'characterised_at_t0' THEN 'reference' ELSE 'query' END AS role, category = 'positive' AS is_positive, sg.family AS pfam_family, g.phylum, o_custkey % 1500 AS length_aa FROM es JOIN orders ON es.protein_id = o_orderkey LEFT JOIN sg ON sg.member = es.protein_id LEFT JOIN g ON g.accession = es.genome WHERE o_custkey % 1500 <= 1024"),
    "first_seen_window": _sql(LABELS, "SELECT protein_id, genome FROM lb JOIN (SELECT l_orderkey, min(l_shipdate) AS fs FROM lineitem GROUP BY l_orderkey) ON l_orderkey = protein_id WHERE positive AND fs > TIMESTAMP '1997-01-01'"),
    "masked_sequences": "SELECT doc_id, md5(regexp_replace(upper(replace(replace(text, 'ß', 'SS'), 'nd', 'nnnn')), 'N{3,}', '@', 'g')) AS masked_md5 FROM documents",
    "truncation_report": "SELECT model, count(*) FILTER (length(text) > most) AS truncated, CAST(sum(least(length(text), most)) AS BIGINT) AS kept, CAST(sum(length(text)) AS BIGINT) AS total FROM documents, (VALUES ('esm2', 1024), ('genos-m', 8192)) t(model, most) GROUP BY model",
    "name_parsing": "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN 'GB_' || c_custkey END AS member, 'P' || c_custkey AS header, CASE WHEN c_custkey % 3 = 0 THEN c_custkey || '.txt' ELSE c_custkey::VARCHAR END AS stem, c_custkey::VARCHAR AS release, 'PF' || c_custkey AS bare, least(5 * (c_custkey % 10), 30) AS wait FROM customer",
    "remaining_work": f"SELECT c_custkey AS genome FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '{DONE}')",
    "missing_preview": f"WITH m AS (SELECT lpad(c_custkey::VARCHAR, 9, '0') AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '{DONE}')) SELECT count(*) AS n_missing, coalesce((SELECT string_agg(k, ', ' ORDER BY k) FROM (SELECT k FROM m ORDER BY k LIMIT 10)), '') || CASE WHEN count(*) > 10 THEN '...' ELSE '' END AS preview FROM m",
    "byte_range_plan": "WITH f AS (SELECT doc_id, n_chars AS total, least(doc_id % 3 * 100, n_chars) AS done, doc_id % 3 + 1 AS np FROM documents), p AS (SELECT *, unnest(range(0, CAST(ceil((total - done) / 500.0) AS BIGINT))) AS k FROM f WHERE total > done) SELECT doc_id, np + k AS part_number, done + k * 500 AS start, least(done + (k + 1) * 500, total) - 1 AS \"end\" FROM p",
    "byte_display": "SELECT o_orderkey, CASE WHEN o_orderkey * 200000.0::DOUBLE >= 1e9 THEN format('{:.2f} GB', o_orderkey * 200000.0::DOUBLE / 1e9) ELSE format('{:.1f} MB', o_orderkey * 200000.0::DOUBLE / 1e6) END AS shown FROM orders",
    "resume_offset": "SELECT l_orderkey AS upload, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS done, CAST(max(l_linenumber) + 1 AS BIGINT) AS next_part FROM lineitem GROUP BY l_orderkey",
    "embedded_documents": """WITH
m AS (SELECT doc_id, string_split(regexp_replace(upper(replace(text, 'ß', 'SS')), 'N{3,}', '@', 'g'), '') AS l FROM documents),
c AS (SELECT doc_id, unnest(l) AS c, generate_subscripts(l, 1) AS i FROM m),
w AS (SELECT doc_id, unicode(c) AS a, lead(unicode(c)) OVER o AS b, lead(unicode(c), 2) OVER o AS d FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT doc_id, (a::BIGINT * 961 + b * 31 + d) * 40503 % 65536 // 256 AS h FROM w WHERE d IS NOT NULL),
s AS (SELECT doc_id, h // 2 % 64 AS k, sum(CASE WHEN h % 2 = 1 THEN 1 ELSE -1 END)::DOUBLE AS x FROM h GROUP BY doc_id, k),
n AS (SELECT doc_id, greatest(sqrt(sum(x * x)), 1e-12) AS n FROM s GROUP BY doc_id),
u AS (SELECT doc_id, k, (x / n)::FLOAT::DOUBLE AS x FROM s JOIN n USING (doc_id))
SELECT doc_id, count(x) FILTER (x <> 0) AS filled, round(coalesce(sum(x * (k + 1)), 0), 4) + 0.0 AS weighted, round(coalesce(sum(abs(x)), 0), 4) + 0.0 AS absolute
FROM documents LEFT JOIN u USING (doc_id) GROUP BY doc_id""",
    "progress_rate": _sql(EVENTS + "pr AS (SELECT *, sum(size) OVER w AS done, (epoch_us(ts) / 1e6) - lag(epoch_us(ts) / 1e6) OVER w AS el FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),", f"SELECT event_id, {r('done', 3)} AS done, {r('CASE WHEN el IS NULL THEN NULL WHEN el = 0 THEN 0 ELSE size / el END', 4)} AS rate, {r('100.0 * done / 1e6', 4)} AS percent FROM pr"),
    "progress_reports": _sql(EVENTS + """
o AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, size, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM ev),
fold AS (
  WITH RECURSIVE f(user_id, i, last, done, base, report, due, rate) AS (
    SELECT user_id, 1::BIGINT, t, size, 0.0::DOUBLE, 0::BIGINT, false, 0.0::DOUBLE FROM o WHERE i = 1
    UNION ALL
    SELECT f.user_id, o.i, CASE WHEN o.t - last > 3600 THEN o.t ELSE last END, done + size, CASE WHEN o.t - last > 3600 THEN done + size ELSE base END,
           report + CASE WHEN o.t - last > 3600 THEN 1 ELSE 0 END, o.t - last > 3600, CASE WHEN o.t - last > 3600 THEN (done + size - base) / (o.t - last) ELSE 0 END
    FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)
  SELECT * FROM f),""", f"SELECT user_id, report, {r('done', 3)} AS done, {r('rate', 5)} AS rate FROM fold WHERE due"),
    "device_plan": "SELECT device, total_gb, quantize_below_gb, CASE WHEN device = 'cuda' AND quantize_below_gb > 0 AND total_gb < quantize_below_gb THEN 4::BIGINT ELSE 0 END AS quantize_bits, CASE device WHEN 'cuda' THEN 'bfloat16' WHEN 'mps' THEN 'float16' ELSE 'float32' END AS dtype FROM (VALUES ('cuda'), ('mps'), ('cpu')) a(device), (VALUES (8.0::DOUBLE), (16.0), (24.0)) b(total_gb), (VALUES (0.0::DOUBLE), (16.0)) c(quantize_below_gb)",
}
