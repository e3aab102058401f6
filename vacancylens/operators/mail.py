"""Mail: job gate, human-sender tests, link buckets, sampling across senders, archive plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancylens import fixed
from vacancylens.functions.links import link_identity, normalize_link
from vacancylens.functions.text import (
    UNICODE_NOCASE, any_contains, blank, col, either, strip, unescape,
)


def job_related(subject: Column | str, content: Column | str) -> Column:
    return F.concat_ws(" ", blank(subject), blank(content)).rlike(UNICODE_NOCASE + fixed.JOB_HINT)


def is_correspondence(sender: Column | str, is_reply: Column | str) -> Column:
    """Did a person write this? Relay senders first, replies next, then anything not automated."""
    s = blank(sender)
    return (
        F.when(s.rlike(UNICODE_NOCASE + fixed.PRIVATE_RELAY), F.lit(True))
        .when(F.coalesce(col(is_reply), F.lit(False)), F.lit(True))
        .otherwise(~s.rlike(UNICODE_NOCASE + fixed.AUTOMATED_SENDER))
    )


def display_name(sender: Column | str) -> Column:
    s = strip(blank(sender))
    name = F.when(s.contains("<"), strip(F.split_part(s, F.lit("<"), F.lit(1)))).otherwise(F.lit(""))
    return F.btrim(name, F.lit("\"' \t"))


def has_human_name(sender: Column | str) -> Column:
    """Two or three name-shaped words and no organisation word before the address."""
    name = display_name(sender)
    parts = F.filter(F.split(F.replace(name, F.lit(","), F.lit(" ")), r"\s+"), lambda w: w != "")
    return (
        (name != "") & ~name.rlike(UNICODE_NOCASE + fixed.ORG_WORD) & F.size(parts).between(2, 3)
        & F.forall(parts, lambda w: w.rlike(fixed.NAME_WORD))
    )


def sender_platform(sender: Column | str) -> Column:
    domain = F.regexp_extract(blank(sender), r"(?U)@([\w.-]+)", 1)
    return F.lower(F.split_part(domain, F.lit("."), F.lit(1)))


def email_source(sender: Column | str, content: Column | str) -> Column:
    """Which kind of sender a message comes from, by its address and the head of its body."""
    s = F.lower(blank(sender))
    head = F.lower(F.substring(blank(content), 1, fixed.MAIL_HEAD_CHARS))
    return (
        F.when(s.contains("linkedin"), F.lit("linkedin"))
        .when(s.contains("indeed"), F.lit("indeed"))
        .when(s.contains("dice") | head.contains("dice"), F.lit("dice"))
        .when(s.contains("remotevibecoding") | head.contains("remotevibecoding"), F.lit("rvc"))
        .otherwise(either(sender_platform(s), F.lit("other")))
    )


def classify_links(df: DataFrame, doc: str, text: str, cap: int | None = None) -> DataFrame:
    """Links in a text: one row per document and kept identity, bucket `job` or `unclassified`.

    A job host wins before the junk tests; junk is dropped and does not claim its identity; the first kept
    occurrence stands for an identity. All are kept unless `cap` bounds each document's bucket, as the mail format does
    with `fixed.MAIL_URL_CAP`.
    """
    raw = F.regexp_extract_all(blank(text), F.lit(f"({fixed.URL_IN_TEXT})"), F.lit(1))
    # Decoded before the explode: a column made after it would be worked out again in every test of the filter.
    found = F.transform(raw, lambda u: unescape(F.rtrim(u, F.lit(".,)>\"'"))))
    rows = df.select(doc, F.posexplode(found).alias("pos", "url")).withColumn("identity", link_identity("url"))
    nocase = UNICODE_NOCASE
    junk = (F.col("url").rlike(nocase + fixed.ASSET_URL) | F.col("url").rlike(nocase + fixed.JUNK_HOST)
            | F.col("url").rlike(nocase + fixed.JUNK_PATH))
    bucket = F.when(any_contains(F.col("url"), fixed.JOB_HOSTS), F.lit("job")).when(~junk, F.lit("unclassified"))
    kept = rows.withColumn("bucket", bucket).filter(F.col("bucket").isNotNull() & (F.col("identity") != ""))
    first = kept.groupBy(doc, "identity").agg(
        F.min_by(F.struct("url", "bucket"), "pos").alias("first"), F.min("pos").alias("pos")
    ).select(doc, "pos", "identity", "first.url", "first.bucket")
    if cap is None:
        return first
    order = Window.partitionBy(doc, "bucket").orderBy("pos")
    return first.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= cap).drop("nth")


def reconcile(extracted: DataFrame, found: DataFrame, mid: str = "mid") -> DataFrame:
    """Extracted jobs of each message plus the links the extraction left out.

    `extracted` has mid, link, company, title; `found` has mid, url.
    """
    useful = extracted.filter((blank("link") != "") | (blank("title") != "") | (blank("email_jd_text") != ""))
    jobs = useful.select(
        mid, normalize_link(strip(blank("link"))).alias("link"), strip(blank("company")).alias("company"),
        strip(blank("title")).alias("title"), F.lit(False).alias("recovered"))
    claimed = jobs.filter(F.col("link") != "").select(mid, link_identity("link").alias("identity")).distinct()
    missed = found.withColumn("identity", link_identity("url")).join(claimed, [mid, "identity"], "left_anti").select(
        mid, normalize_link("url").alias("link"), F.lit("").alias("company"), F.lit("").alias("title"),
        F.lit(True).alias("recovered"))
    return jobs.unionByName(missed)


def unclassified_hosts(links: DataFrame, url: str = "url", top: int | None = fixed.UNCLASSIFIED_HOSTS_NAMED) -> DataFrame:
    """Hosts of unclassified links that look like job boards, most frequent first, with the overall totals."""
    raw_host = F.regexp_extract(col(url), r"^https?://([^/?#]+)", 1)
    rest = F.regexp_extract(col(url), r"(?s)^https?://[^/?#]+(.*)$", 1)
    shaped = (raw_host != "") & (raw_host.rlike(UNICODE_NOCASE + fixed.ATS_HOST) | rest.rlike(UNICODE_NOCASE + fixed.JOB_PATH))
    counts = links.groupBy(F.when(shaped, F.lower(raw_host)).alias("host")).agg(F.count("*").alias("n"))
    ranked = counts.filter(F.col("host").isNotNull()).orderBy(F.desc("n"), "host")
    if top is not None:
        ranked = ranked.limit(top)
    total = counts.agg(F.sum("n").alias("total_links"))  # one row
    return ranked.crossJoin(F.broadcast(total))


def round_robin(df: DataFrame, n: int, klass: str, ord_col: str, first_classes=fixed.MAIL_CLASS_ORDER) -> DataFrame:
    """n rows taken in turn from each class: the named classes first, then the others as they first appear."""
    rank = F.lit(None).cast("int")
    for i, name in enumerate(first_classes):
        rank = F.when(F.col(klass) == name, F.lit(i)).otherwise(rank)
    # A row past place n of its class can never be taken, so the rank limit runs before the shuffle.
    nth = F.row_number().over(Window.partitionBy(klass).orderBy(ord_col))
    firsts = df.groupBy(klass).agg(F.min(ord_col).alias("first_seen"))
    ranked = df.withColumn("turn", nth).filter(F.col("turn") <= n).join(firsts, klass)
    return (ranked.withColumn("class_rank", F.coalesce(rank, F.lit(len(first_classes))))
            .orderBy("turn", "class_rank", "first_seen").limit(n).drop("turn", "class_rank", "first_seen"))


def archive_plan(extracted: DataFrame, resolved: DataFrame, key: str = "link_key") -> DataFrame:
    """Messages whose extracted rows are all resolved: `archive`, or `hold` where the sender names a person.

    Rows a person wrote are removed first. `resolved` is a table of keys. One row of `extracted` carries ord,
    email_mid, email_sender, email_subject, company, title, from_correspondence and its key.
    """
    rows = extracted.filter((blank("email_mid") != "") & ~F.col("from_correspondence"))
    marked = rows.join(resolved.select(F.col(key), F.lit(True).alias("resolved")).distinct(), key, "left")
    head = F.min_by(F.struct("email_sender", "email_subject", "company", "title"), "ord")
    per_mail = marked.groupBy("email_mid").agg(
        F.every(F.coalesce("resolved", F.lit(False))).alias("done"), head.alias("head"), F.count("*").alias("n_jobs"))
    human = has_human_name("sender")
    return per_mail.filter("done").select(
        F.col("email_mid").alias("mid"), F.col("head.email_sender").alias("sender"),
        F.col("head.email_subject").alias("subject"), "n_jobs",
        F.concat(either("head.company", F.lit("?")), F.lit(" — "), either("head.title", F.lit("?"))).alias("context"),
    ).withColumn("action", F.when(human, F.lit("hold")).otherwise(F.lit("archive"))).withColumn(
        "reason", F.when(human, F.concat(F.lit("sender names a person: "), display_name("sender"))).otherwise(F.lit("")))
