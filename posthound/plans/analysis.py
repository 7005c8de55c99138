"""From raw messages to verdicts: parse, run every rule, score. Each rule reads the relation it needs; findings are one union."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from posthound.functions import urls
from posthound.operators import anchors, authresults, claims, deception, documents, files, messages, scripts, services
from posthound.plans.registry import Registry
from posthound.plans.scoring import ScoreConfig, verdicts
from posthound.session import spread, written
from posthound.sources import adapters as src
from posthound.sources import mail

R = Registry()
READERS = (
    ("pdf", "detected_type = 'pdf'", documents.pdf_findings),
    ("lnk", "detected_type = 'lnk'", documents.lnk_findings),
    ("office", "detected_type like 'office/%' and detected_type <> 'office/onenote' or lower(filename) rlike '[.](docx|docm|xlsx|xlsm|pptx|pptm|dotm)$'", documents.office_findings),
    ("onenote", "detected_type = 'office/onenote'", documents.onenote_findings),
    ("pe", "detected_type = 'exe/pe'", lambda f: documents.pe_findings(f, F.lit("2100-01-01").cast("timestamp"))),
)


#: Findings that a task ranks and scores.
FINDINGS_PER_TASK = 100_000
SCRIPT_NAMES = ("js", "jse", "vbs", "vbe", "wsf", "ps1", "bat", "cmd", "py", "sh")


def severity(score: Column) -> Column:
    return F.when(score >= 60, 3).when(score >= 25, 2).when(score > 0, 1).otherwise(0)


@dataclass(frozen=True)
class Inputs:
    """What analysers read: parsed messages, attachments, links with their shown texts, URLs, and the settings of a run."""

    parsed: DataFrame
    parts: DataFrame
    anchors: DataFrame
    seen: DataFrame
    company: tuple[str, ...] = ()
    trusted_servers: tuple[str, ...] = ()

    def share(self, bucket: int, of: int, salt: int) -> Inputs:
        """The messages of one bucket, with all that belongs to them."""
        own = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long"), F.lit(salt)), F.lit(of)) == bucket
        return replace(self, parsed=self.parsed.filter(own("id")), parts=self.parts.filter(own("mail")), anchors=self.anchors.filter(own("mail")), seen=self.seen.filter(own("mail")))

    @property
    def named(self) -> DataFrame:
        return self.parts.select("row", "mail", F.element_at(F.split("filename", "/"), -1).alias("filename"), "detected_type", "data")


#: An analyser: findings(mail, rule, score and, if it has them, category, severity, artifact) of what it reads.
Analyser = Callable[[Inputs], DataFrame]
#: All analysers by name with the category of findings that name none; more can be added, and any left out, by name.
ANALYSERS: dict[str, tuple[str, Analyser]] = {}


def analyser(name: str, category: str) -> Callable[[Analyser], Analyser]:
    def put(f: Analyser) -> Analyser:
        ANALYSERS[name] = (category, f)
        return f

    return put


FINDING = "analysis_id long, rule string, score int, category string, severity int, artifact_id string"
ERROR = "analyser string, share string, error string, message string"


def _shaped(rows: DataFrame, category: str) -> DataFrame:
    given = lambda c, default: (F.col(c) if c in rows.columns else default)
    return rows.select(F.col("mail").cast("long").alias("analysis_id"), "rule", F.col("score").cast("int").alias("score"), given("category", F.lit(category)).alias("category"), given("severity", severity(F.col("score"))).cast("int").alias("severity"), given("artifact", F.lit(None)).cast("string").alias("artifact_id"))


def run_analysers(inputs: Inputs, analysers: dict[str, tuple[str, Analyser]] | None = None, split: int = 8, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """(findings, errors): each analyser runs and is written by itself, so that one that fails costs no other its findings.

    An analyser that cannot even build its plan is one error. One that fails on the rows is run again on `split` shares of the
    messages, `depth` times over: the shares that fail are errors, the others keep their findings.
    """
    spark, found, errors = inputs.parsed.sparkSession, [], []

    def attempt(name: str, category: str, f: Analyser, own: Inputs, share: str, left: int) -> None:
        try:
            rows = _shaped(f(own), category)
        except Exception as e:  # noqa: BLE001  whatever an analyser raises is its error, not the run's
            errors.append((name, share, type(e).__name__, str(e)[:500]))
            return
        try:
            found.append(written(rows, f"findings-{name}"))
        except Exception as e:  # noqa: BLE001
            if not left:
                errors.append((name, share, type(e).__name__, str(e)[:500]))
                return
            for b in range(split):
                attempt(name, category, f, own.share(b, split, left), f"{share}{b}/{split}.", left - 1)

    for name, (category, f) in (ANALYSERS if analysers is None else analysers).items():
        attempt(name, category, f, inputs, "", depth)
    every = spark.createDataFrame([], FINDING)
    for rows in found:
        every = every.unionByName(rows)
    return every, spark.createDataFrame(errors, ERROR)


@analyser("links", "phishing")
def _links(x: Inputs) -> DataFrame:
    return deception.deceptive_links(x.anchors.withColumnRenamed("mail", "key"), x.company).select(F.col("key").alias("mail"), "rule", "severity", "score")


@analyser("urls", "phishing")
def _urls(x: Inputs) -> DataFrame:
    own = services.own_table(x.seen.sparkSession)
    every = urls.findings(x.seen, "mail", "url").unionByName(deception.idn_findings(x.seen, "mail", "url")).unionByName(services.service_findings(x.seen, own, "mail", "url"))
    return urls.grouped(every, "mail").select("mail", "rule", "severity", "score")


@analyser("content", "phishing")
def _content(x: Inputs) -> DataFrame:
    counts = x.parts.groupBy("mail").agg(F.count(F.lit(1)).alias("attachments"), F.count_if(F.col("encrypted") | F.col("detected_type").startswith("archive/") | F.col("detected_type").startswith("exe/")).alias("risky"))
    has_urls = x.seen.select("mail").distinct().withColumn("has_urls", F.lit(True))
    # Texts are read where they lie; only what their wording shows is joined.
    said = messages.wordings(x.parsed.select(F.col("id").alias("mail"), "subject", F.concat_ws(" ", "body_text", F.regexp_replace("body_html", "<[^>]*>", " ")).alias("body")))
    rows = said.join(counts, "mail", "left").join(has_urls, "mail", "left").na.fill({"attachments": 0, "risky": 0, "has_urls": False})
    return messages.wording_findings(rows.withColumnRenamed("mail", "id")).withColumnRenamed("id", "mail")


@analyser("headers", "spoofing")
def _headers(x: Inputs) -> DataFrame:
    told = authresults.collected(x.parsed.select("id", F.posexplode("headers").alias("position", "h")).select("id", "position", "h.*"), x.trusted_servers)
    # Dealt by number of mails: by bytes, any number of such short rows is one task.
    heads = spread(x.parsed.select("id", "from_addr", "from_display", "reply_to", F.regexp_replace("return_path", "[<>]", "").alias("return_path")), src.PER_TASK, "id").join(told.select("id", "has_auth", "trusted_auth", *messages.METHODS), "id", "left")
    heads = heads.na.fill("", list(messages.METHODS)).na.fill(False, ["has_auth", "trusted_auth"])
    return messages.header_findings(heads, x.company).withColumnRenamed("id", "mail")


@analyser("filetype", "suspicious_file")
def _filetype(x: Inputs) -> DataFrame:
    own = lambda c: F.concat_ws("/", F.col("mail").cast("string"), c)
    tree = x.parts.select(F.col("mail").cast("string").alias("mail"), own("id").alias("id"), F.when(F.col("parent").isNotNull(), own("parent")).alias("parent"), F.element_at(F.split("filename", "/"), -1).alias("filename"), "detected_type", "depth", "encrypted", "note")
    return files.filetype_findings(tree).withColumn("mail", F.substring_index("id", "/", 1)).withColumn("artifact", F.expr("substring(id, length(mail) + 2)"))


def _of_parts(x: Inputs, rows: DataFrame) -> DataFrame:
    return rows.join(x.named.select("row", "mail", F.col("filename").alias("artifact")), "row")


def _texts(x: Inputs) -> DataFrame:
    return x.named.filter("detected_type in ('unknown', 'text/html', 'image/svg', 'text/xml')").select("row", F.try_to_binary(F.hex("data"), F.lit("hex")).cast("string").alias("t"), "detected_type")


@analyser("script", "suspicious_file")
def _scripts(x: Inputs) -> DataFrame:
    carried = x.named.filter(files.extension(F.col("filename")).isin(*SCRIPT_NAMES)).select("mail", F.lit("script.attachment").alias("rule"), F.lit(40).alias("score"), F.col("filename").alias("artifact"))
    return _of_parts(x, scripts.script_findings(_texts(x), "row", "t")).select("mail", "rule", "score", "artifact").unionByName(carried)


@analyser("html", "suspicious_file")
def _html(x: Inputs) -> DataFrame:
    return _of_parts(x, scripts.html_findings(_texts(x).filter("detected_type in ('text/html', 'image/svg')"), "row", "t"))


def _reader(kind: str, where: str, rule: Callable[[DataFrame], DataFrame]) -> Analyser:
    return lambda x: _of_parts(x, rule(documents.features(x.named.filter(where).select(F.col("row").alias("id"), "data"), kind)).withColumnRenamed("id", "row"))


for _kind, _where, _rule in READERS:
    ANALYSERS[_kind] = ("suspicious_file", _reader(_kind, _where, _rule))


def brand_analyser(brands: DataFrame) -> Analyser:
    """Names and hosts that pose as those of brands(brand, phrases, domains) or of the company."""

    def run(x: Inputs) -> DataFrame:
        heads = claims.brand_findings(x.parsed.select("id", "from_addr", "from_display", "reply_to"), brands, (), x.company).withColumnRenamed("id", "mail")
        like = claims.imitating_urls(x.seen, brands, x.company).groupBy("mail", "rule").agg(F.max("score").alias("score"))
        return heads.select("mail", "rule", "score", "category").unionByName(like.withColumn("category", F.lit("phishing")).select("mail", "rule", "score", "category"))

    return run


def table_analyser(rules: DataFrame) -> Analyser:
    """A table of rules on every attachment, by the index of their anchors."""
    return lambda x: _of_parts(x, anchors.scan_table(x.named.select("row", "data", "detected_type"), rules, "row", "data", "detected_type"))


def inputs_of(raw: DataFrame, company: tuple[str, ...] = (), trusted_servers: tuple[str, ...] = ()) -> Inputs:
    """The relations of raw(id long, raw binary), written once for all analysers."""
    parsed = written(mail.parse(raw, "id", "raw"), "parsed")
    parts = mail.artifacts(parsed.withColumnRenamed("id", "mail"), "mail")
    parts = written(parts.withColumn("row", F.xxhash64("mail", "position")), "attachments")
    links = mail.html_facts(parsed.withColumnRenamed("id", "mail"), "mail", "body_html").select("mail", F.explode("links").alias("l")).select("mail", "l.url", "l.shown")
    links = written(links, "links")
    # explode_outer: explode would look for the URLs of each text twice, once to see if it has any.
    may = F.col("body_text").contains("://") | F.col("body_text").rlike(r"[wW]{3}\.")
    plain = parsed.filter(may).select(F.col("id").alias("mail"), F.explode_outer(urls.in_text(F.col("body_text"))).alias("url")).filter("url is not null")
    seen = written(links.select("mail", "url").unionByName(plain).withColumn("url", urls.normalise(F.col("url"))).distinct(), "urls")
    return Inputs(parsed, parts, links, seen, company, trusted_servers)


def analyse_all(raw: DataFrame, company: tuple[str, ...] = (), trusted_servers: tuple[str, ...] = (), config: ScoreConfig = ScoreConfig(), brands: DataFrame | None = None, rules: DataFrame | None = None, analysers: dict[str, tuple[str, Analyser]] | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(findings, attachments, verdicts, errors) of raw(id long, raw binary).

    brands and rules add the analysers `brands` and `yara`; analysers replaces the registered ones.
    """
    x = inputs_of(raw, company, trusted_servers)
    chosen = dict(ANALYSERS if analysers is None else analysers)
    if brands is not None:
        chosen["brands"] = ("phishing", brand_analyser(brands))
    if rules is not None:
        chosen["yara"] = ("malware", table_analyser(rules))
    every, errors = run_analysers(x, chosen)
    # Of several findings of one rule on one part the best score counts; then positions follow.
    best = F.max(F.struct("score", "severity", "category")).alias("b")
    every = spread(every, FINDINGS_PER_TASK, "analysis_id").groupBy("analysis_id", "rule", "artifact_id").agg(best).select("analysis_id", "rule", "artifact_id", "b.*")
    order = W.partitionBy("analysis_id").orderBy("rule", "artifact_id")
    every = written(every.withColumns({"position": F.row_number().over(order) - 1, "malware_family": F.lit(None).cast("string")}), "findings")
    # Merged: Spark would broadcast the scores of millions of mails, whose bytes are few when shuffled.
    return every, x.parts.drop("data", "row"), verdicts(spread(every, FINDINGS_PER_TASK, "analysis_id"), x.parsed.select("id", "from_addr").hint("merge"), config), errors


def analyse(raw: DataFrame, company: tuple[str, ...] = (), trusted_servers: tuple[str, ...] = (), config: ScoreConfig = ScoreConfig(), **more) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings, attachments, verdicts) of raw(id long, raw binary); an analyser that fails is an error here."""
    found, parts, levels, errors = analyse_all(raw, company, trusted_servers, config, **more)
    if bad := errors.limit(5).collect():
        raise RuntimeError("; ".join(f"{e.analyser}: {e.error}: {e.message}" for e in bad))
    return found, parts, levels


@R.add()
def message_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a mail through every analyser."""
    rows = mail.document_mails(spark, sf_dir).select(F.col("remote_id").cast("long").alias("id"), "raw")
    return analyse(rows, ("corp.example",))[2]
