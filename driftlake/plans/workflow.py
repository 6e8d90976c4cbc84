"""The steps from raw files to evaluated scores, each from written tables to written tables.

Tables lie under one root in any store Spark writes: root/release/name. Steps
that add to a table skip what it has, so a step that broke off goes on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Scorer
from ..functions.text import strip_version
from ..functions.vectors import as_doubles
from ..operators import embedders, evaluation, evt, families, knn, labeling, sampling, separation
from ..sources import archive, fasta, sinks
from ..sources import tables as src


def _keyed(rows: DataFrame) -> DataFrame:
    """protein_id with its genome, since ids may repeat across genomes."""
    return rows.withColumn("protein_id", F.concat_ws("\u0001", "genome", "protein_id"))


class Workflow:
    def __init__(self, spark: SparkSession, root: str, release: str, settings: Scorer = Scorer()):
        self.spark, self.base, self.settings = spark, f"{root.rstrip('/')}/{release}", settings
        self.release = release

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def write(self, name: str, rows: DataFrame, mode: str = "overwrite") -> DataFrame:
        rows.write.mode(mode).parquet(self.path(name))
        return self.read(name)

    def has(self, name: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name) + "/_SUCCESS")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def log(self, title: str, config: str = "", result: str = "", next_step: str = "") -> None:
        sinks.log_run(self.spark, self.path("run_log"), title, config, result, next_step)

    def preprocess_taxonomy(self, paths: dict[str, str]) -> DataFrame:
        """taxonomy and taxonomy_summary."""
        t = self.write("taxonomy", src.read_taxonomy(self.spark, paths))
        per_source = [F.count_if(F.col("source") == s).alias(s) for s in sorted(paths)]
        sinks.write_document(t.agg(F.count("*").alias("total"), *per_source, *[F.countDistinct(c).alias(f"n_{c}") for c in ("phylum", "genus", "species")], F.count_if(F.col("species") == "").alias("no_species")), self.path("taxonomy_summary"))
        return t

    def build_panel(self, metadata: list[str], target: int = 500, floor: int = 2, cap: int = 30, seed: int = 42) -> DataFrame:
        """genome_panel and its summary; metadata: paths of the representative flags."""
        flags = None
        for p in metadata:
            rows = src.representatives(src.read_metadata(self.spark, p, ["accession", "gtdb_representative"]))
            flags = rows if flags is None else flags.unionByName(rows)
        chosen, strata = sampling.panel(self.read("taxonomy"), flags.distinct(), target, floor, cap, seed)
        asked = F.struct(*[F.lit(v).alias(k) for k, v in (("target", target), ("floor", floor), ("cap", cap), ("seed", seed))])
        summary = strata.agg(F.sum("size").alias("rows"), F.max("fraction").alias("fraction"), F.count("*").alias("strata"), F.count_if(F.col("size") > 0).alias("strata_drawn"), F.map_from_entries(F.collect_list(F.struct("phylum", "size"))).alias("sizes")).withColumn("asked", asked)
        sinks.write_document(summary, self.path("genome_panel_summary"))
        return self.write("genome_panel", chosen)

    def extract_panel(self, archives: str, suffix: str = "_protein.faa", name: str = "panel_sequences") -> tuple[DataFrame, DataFrame]:
        """(sequences, missing genomes). Genomes that are there already are not read again."""
        wanted = self.read("genome_panel").select(F.col("accession").alias("key"))
        if self.has(name):
            wanted = labeling.remaining(wanted, self.read(name).select(F.col("genome").alias("key")), "key")
        members = archive.read_archives(self.spark, archives, suffix, wanted)
        records = members.select(F.col("key").alias("genome"), F.explode(F.split(F.concat(F.lit("\n"), F.col("content").cast("string")), "\n>")).alias("v")).where(F.trim("v") != "")
        head = F.regexp_extract("v", r"^(\S+)", 1)
        body = F.regexp_replace(F.regexp_replace("v", r"^[^\r\n]*", ""), r"\s+", "")
        got = self.write(name, records.select("genome", head.alias("protein_id"), body.alias("seq")), "append")
        return got, labeling.remaining(self.read("genome_panel").select(F.col("accession").alias("genome")), got, "genome")

    def label(self, hits_t0: DataFrame, hits_t1: DataFrame, families_t0: DataFrame, families_t1: DataFrame, limit_genomes: int | None = None) -> DataFrame:
        """panel_labels of the genomes that have none; hits: protein_id, family (versioned), genome. Keys are genome and protein, so ids may repeat across genomes."""
        proteins = self.read("panel_sequences").select("genome", "protein_id")
        genomes = proteins.select("genome").distinct()
        if limit_genomes:
            genomes = genomes.orderBy("genome").limit(limit_genomes)
        if self.has("panel_labels"):
            genomes = labeling.remaining(genomes, self.read("panel_labels"), "genome")
        genomes = genomes.cache()
        keyed = lambda rows: _keyed(rows.join(genomes, "genome", "left_semi"))
        new = labeling.new_families(families_t0, families_t1)
        labels = labeling.snapshot_labels(keyed(proteins), keyed(hits_t0).select("protein_id", "family"), keyed(hits_t1).select("protein_id", "family"), new)
        out = self.write("panel_labels", labels.withColumn("protein_id", F.element_at(F.split("protein_id", "\u0001"), 2)), "append")
        # a genome here has proteins, so its rows tell that it is done: one write, whole or not at all
        genomes.unpersist()
        self.log("snapshot differencing", result=str(labeling.summary(out).first().asDict()), next_step=labeling.go_no_go(out).first()["decision"])
        return out

    def search(self, make, limit_genomes: int | None = None) -> DataFrame:
        """Hits of the panel's sequences by a scanner of `operators.families`: genome, protein_id, family, score."""
        rows = self.read("panel_sequences")
        if limit_genomes:
            rows = rows.join(rows.select("genome").distinct().orderBy("genome").limit(limit_genomes), "genome", "left_semi")
        return families.search(rows, make)

    def build_embedding_sample(self, dark_negative_cap: int = 30000, characterised_cap: int = 30000, seed: int = 42) -> DataFrame:
        groups = self.read("genome_panel").select(F.col("accession").alias("genome"), F.col("phylum").alias("stratum"))
        return self.write("embedding_sample", sampling.embedding_sample(self.read("panel_labels"), groups, dark_negative_cap, characterised_cap, seed))

    def embed_sample(self, model: str, batch_size: int = 64, most_tokens: int | None = None) -> tuple[DataFrame, int]:
        """(embeddings with category, how many sampled proteins have no sequence)."""
        sample, sequences = self.read("embedding_sample"), self.read("panel_sequences")
        both = sample.join(sequences, ["genome", "protein_id"])
        out = embedders.embed(both.select("genome", "protein_id", "category", "seq"), model, "seq", batch_size, most_tokens).drop("seq")
        missing = sample.join(sequences.select("genome", "protein_id"), ["genome", "protein_id"], "left_anti").count()
        return self.write(f"{model}_embeddings", out.withColumn("id", F.xxhash64("genome", "protein_id"))), missing

    def _parts(self, model: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        e = self.read(f"{model}_embeddings")
        unit = knn.unit_vectors(e, "id", "embedding", "genome", "protein_id", "category")
        return e, unit.where("category = 'characterised_at_t0'"), unit.where("category <> 'characterised_at_t0'")

    def score(self, model: str, k: int | None = None, q: float | None = None, below: str = "zero") -> DataFrame:
        """novelty_scores: genome, protein_id, category, raw_knn_distance, evt_novelty_score, is_positive, id."""
        if below not in ("zero", "ecdf"):
            raise ValueError(f"below: zero or ecdf, not {below!r}")
        k, q = k or self.settings.k, q or self.settings.threshold_quantile
        _, references, queries = self._parts(model)
        loo = knn.mean_distance(references, references, k, exclude_self=True).cache()
        fit = evt.fit_mle(loo, q)
        distances = knn.mean_distance(queries, references, k)
        scored = evt.add_novelty(distances, fit) if below == "zero" else evt.add_novelty_ecdf(distances, loo, fit)
        names = queries.select("id", "genome", "protein_id", "category", (F.col("category") == "positive").alias("is_positive"))
        out = self.write(f"{model}_novelty_scores", names.join(scored, "id").withColumnsRenamed({"distance": "raw_knn_distance", "novelty": "evt_novelty_score"}))
        self.log(f"novelty scores ({model}, {self.release})", f"k={k}, q={q}, below={below}", str({n: round(float(v), 6) for n, v in fit.items()}))
        return out

    def evaluate(self, model: str, hits: DataFrame, k: int | None = None, q: float | None = None, min_family_size: int = 20, precision_k: tuple[int, ...] | None = None, bins: int | None = None) -> dict[str, DataFrame]:
        """precision, lift, calibration, roc, histogram of stored scores, and the AUROC of the largest family held out (hits: genome, protein_id, family)."""
        k, q, seed = k or self.settings.k, q or self.settings.threshold_quantile, self.settings.seed
        if not self.has(f"{model}_novelty_scores"):
            raise FileNotFoundError(f"{model}_novelty_scores: score first")
        scored = self.read(f"{model}_novelty_scores").select("id", F.col("evt_novelty_score").alias("novelty"), "is_positive").cache()
        out = {"precision": evaluation.precision_at(scored, list(precision_k or self.settings.precision_k)), "lift": evaluation.lift_curve(scored), "calibration": evaluation.calibration(scored, bins or self.settings.bins), "roc": evaluation.roc(scored), "histogram": evaluation.histogram(scored)}
        references = _keyed(self._parts(model)[1])
        own = _keyed(hits).join(references.select("protein_id"), "protein_id", "left_semi")
        family = separation.largest_family(own, min_family_size).first()
        if family is None:
            raise ValueError(f"no family with {min_family_size} unambiguous reference members")
        members = separation.single_family_members(own).where(F.col("family") == family["family"]).select(F.col("member").alias("protein_id"))
        held, left = references.join(members, "protein_id", "left_semi"), references.join(members, "protein_id", "left_anti")
        loo = knn.mean_distance(left, left, k, exclude_self=True).cache()
        fit = evt.fit_mle(loo, q)
        normal = sampling.sample_at_most(loo, held.count(), seed, "id").withColumn("is_positive", F.lit(False))
        both = knn.mean_distance(held, left, k).withColumn("is_positive", F.lit(True)).unionByName(normal)
        out["held_out"] = evaluation.auroc(evt.add_novelty(both, fit)).withColumn("family", F.lit(family["family"]))
        return out

    def compare_embeddings(self, model: str, hits: DataFrame, n_genomes: int = 30, per_family: int = 5, max_families: int = 20, seed: int = 42) -> DataFrame:
        """Separation of families on a phylum-diverse sample of genomes; hits: genome, protein_id, family."""
        genomes = sampling.stratified_at_most(self.read("genome_panel"), n_genomes, seed, "accession", "phylum").select(F.col("accession").alias("genome"))
        proteins = _keyed(self.read("panel_sequences").join(genomes, "genome", "left_semi"))
        subset = separation.labeled_subset(_keyed(hits).join(proteins.select("protein_id"), "protein_id", "left_semi").select("protein_id", "family"), 3, per_family, max_families)
        labelled = proteins.join(subset.select(F.col("member").alias("protein_id"), "family"), "protein_id")
        vectors = embedders.embed(labelled, model, "seq").select(F.col("family").alias("label"), as_doubles(F.col("embedding")).alias("v"))
        return separation.separation(vectors).withColumn("model", F.lit(model))


def families_of(hits: DataFrame) -> DataFrame:
    return hits.select(strip_version(F.col("family")).alias("family")).distinct()


def compare_fasta(spark: SparkSession, path: str, hits: DataFrame, model: str, per_family: int = 4, max_families: int = 6) -> DataFrame:
    """Separation of families among the sequences of one FASTA file; hits: protein_id, family."""
    rows = fasta.last_of_each_id(fasta.read_fasta(spark, path)).select(F.col("record_id").alias("protein_id"), "seq")
    subset = separation.labeled_subset(hits.join(rows.select("protein_id"), "protein_id", "left_semi"), 3, per_family, max_families)
    labelled = rows.join(subset.select(F.col("member").alias("protein_id"), "family"), "protein_id")
    vectors = embedders.embed(labelled, model, "seq").select(F.col("family").alias("label"), as_doubles(F.col("embedding")).alias("v"))
    return separation.separation(vectors).withColumn("model", F.lit(model))


# Short made-up sequences.
TOY = {"nucleotides": ("ACGTACGTACGT", "ACGTTGCANNNNACGT", "GGGGCCCCTTAA"), "proteins": ("MKTAYIAKQRQISFVK", "MSHHWGYGKHNGPEHW", "MAAAKKKLLLGGG")}


def smoke(spark: SparkSession, models: list[str]) -> DataFrame:
    """model, kind, n, dimension, finite: each backend over short sequences of both kinds."""
    out = None
    for model in models:
        for kind, sequences in TOY.items():
            got = embedders.embed(spark.createDataFrame([(s,) for s in sequences], "s string"), model, "s")
            row = got.agg(F.lit(model).alias("model"), F.lit(kind).alias("kind"), F.count("embedding").alias("n"), F.max(F.size("embedding")).alias("dimension"), F.min(F.forall("embedding", lambda x: ~F.isnan(x))).alias("finite"))
            out = row if out is None else out.unionByName(row)
    return out


def embed_fasta(spark: SparkSession, path: str, model: str, batch_size: int = 64) -> DataFrame:
    """record_id, embedding of a FASTA file; of ids that repeat, the last."""
    return embedders.embed(fasta.last_of_each_id(fasta.read_fasta(spark, path)).select("record_id", "seq"), model, "seq", batch_size).drop("seq")
