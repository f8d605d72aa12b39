"""Same-site test between a page and its links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import urls as U

# The public suffixes used when no table is given.  A full list
# (about ten thousand rows, ``*.`` and ``!`` rules included) is a parameter.
DEFAULT_SUFFIXES = ["com", "net", "org", "io", "cn", "uk", "co.uk", "com.cn", "github.io", "*.ck", "!www.ck"]


def default_suffixes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in DEFAULT_SUFFIXES], "suffix string")


def registrable_domains(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """``host, domain``: public suffix plus one label; hosts that are no more than a suffix drop out.

    Where no rule matches, the last label is the suffix.

    Works on distinct hosts, so a hot host is looked up once.  The suffix join
    carries no broadcast hint: the size check stays with the optimizer.
    """
    labels = hosts.select("host", F.split("host", r"\.").alias("labels"))
    named = labels.where(~F.col("host").rlike(r"^[0-9.]+\z|^\[|:") & (F.size("labels") > 1))
    tails = named.select("host", "labels", F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("n"))
    tail = tails.withColumn("tail", F.array_join(F.slice("labels", -F.col("n"), F.col("n")), "."))
    candidates = tail.select(
        "host", "labels", "n", F.explode(F.array("tail", F.concat(F.lit("!"), F.col("tail")), F.regexp_replace("tail", r"^[^.]*", "*"))).alias("suffix")
    )
    given = suffixes.select("suffix", F.lit(True).alias("given")).distinct()
    # the last label by itself is the rule where no other is given
    hit = candidates.join(given, "suffix", "left").where(F.col("given") | ((F.col("n") == 1) & (F.col("suffix") == F.element_at("labels", -1))))
    exception = F.col("suffix").startswith("!")
    # an exception rule beats every other; its suffix is one label shorter
    longest = hit.groupBy("host", "labels").agg(
        F.max_by(F.col("n") - exception.cast("int"), F.struct(exception, F.col("n"))).alias("n")
    )
    sized = longest.where(F.size("labels") > F.col("n"))
    return sized.select("host", F.array_join(F.slice("labels", -(F.col("n") + 1), F.col("n") + 1), ".").alias("domain"))


def _bare(host: Column) -> Column:
    return F.regexp_replace(host, r"\.\z", "")


def same_site_links(links: DataFrame, suffixes: DataFrame, ignore_scheme: bool = False) -> DataFrame:
    """Whether each link ``(page_id, page_url, url)`` stays on the page's site."""
    staged = links.withColumns(
        {
            "_a": U.host_of(F.col("page_url")),
            "_b": U.host_of(F.col("url")),
            "_scheme": U.scheme_of(F.col("page_url")) == U.scheme_of(F.col("url")),
        }
    )
    hosts = staged.select(F.explode(F.array(_bare(F.col("_a")), _bare(F.col("_b")))).alias("host")).where("host <> ''").distinct()
    domains = registrable_domains(hosts, suffixes)
    joined = (
        staged.withColumns({"_ha": _bare(F.col("_a")), "_hb": _bare(F.col("_b"))})
        .join(domains.select(F.col("host").alias("_ha"), F.col("domain").alias("_da")), "_ha", "left")
        .join(domains.select(F.col("host").alias("_hb"), F.col("domain").alias("_db")), "_hb", "left")
    )
    scheme = F.lit(True) if ignore_scheme else F.col("_scheme")
    dots = F.col("_a").endswith(".") == F.col("_b").endswith(".")
    same = (
        (F.col("_a") != "")
        & (F.col("_b") != "")
        & scheme
        & ((F.col("_a") == F.col("_b")) | (dots & F.coalesce(F.col("_da") == F.col("_db"), F.lit(False))))
    )
    return joined.select("page_id", "url", same.alias("same_site"), F.when(same, "include").otherwise("omit").alias("credentials"))
