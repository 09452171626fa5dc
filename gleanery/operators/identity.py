"""Whether a board's company page is the firm: evidence, verdicts, selection and the gate for imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.board_links import SHARED_HOSTS
from gleanery.functions.text import _c, filled, word_key
from gleanery.functions.urls import company_ref, official_host

# Fixed values.
POLICY = "official-company-identity-v1"
REFUSED = ("blocked", "rate_limited")
MOST_CANDIDATES = 5


def json_text(x: Column | str) -> Column:
    """A string as JSON text of ASCII only, as a fingerprint needs it."""
    inner = F.regexp_replace(F.regexp_replace(_c(x), r"\\", r"\\\\"), '"', r'\\"')
    return F.concat(F.lit('"'), inner, F.lit('"'))


def targets(firms: DataFrame) -> DataFrame:
    """slug, official_host, names (sorted) and fingerprint of firms (slug, firm, website, legal_name, company_aliases).

    The fingerprint is the SHA-256 of the target as JSON with sorted keys. Names outside ASCII are
    written as they are, so only there it differs from a fingerprint over escaped text.
    """
    none = F.array().cast("array<string>")
    f = firms.select("slug", "website", F.posexplode(F.concat(F.array("firm", "legal_name"), F.coalesce("company_aliases", none))).alias("_p", "_n"))
    named = f.select("slug", "website", word_key("_n", ampersand=True).alias("_k"))
    t = named.groupBy("slug", "website").agg(F.array_sort(F.collect_set(F.when(F.col("_k") != "", F.col("_k")))).alias("names"))
    t = t.select("slug", F.coalesce(official_host("website", SHARED_HOSTS), F.lit("")).alias("official_host"), "names")
    text = F.concat(F.lit('{"names": ['), F.array_join(F.transform("names", json_text), ", "), F.lit('], "official_host": '), json_text("official_host"), F.lit(', "slug": '), json_text("slug"), F.lit("}"))
    return t.withColumn("fingerprint", F.sha2(text, 256))


def evaluated(facts: DataFrame) -> DataFrame:
    """facts with status and reason; the first rule that fits decides.

    Needs official_host, names (target); company_url, requested_url, company_id, canonical_conflict,
    hosts (official hosts of the profile's sites), display_name, observed_keys (names as word keys);
    proof_source_host, proof_target (a link on the firm's own site), source.
    """
    expected = filled("official_host")
    numeric = (F.col("source") == "linkedin") & F.col("company_id").isNotNull() & F.col("requested_url").endswith(F.concat(F.lit("/company/"), F.col("company_id"), F.lit("/")))
    redirected = F.coalesce("canonical_conflict", F.lit(False)) | (~F.col("company_url").eqNullSafe(F.col("requested_url")) & ~F.coalesce(numeric, F.lit(False)))
    hosts = F.array_distinct(F.filter("hosts", lambda h: h.isNotNull() & (h != "")))
    only = (F.size(hosts) == 1) & F.array_contains(hosts, F.col("official_host"))
    named = F.arrays_overlap("observed_keys", "names")
    proof = F.coalesce((F.col("proof_target") == F.col("company_url")) & (F.col("proof_source_host") == F.col("official_host")), F.lit(False))
    s = lambda status, reason: F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    verdict = (
        F.when(expected.isNull(), s("unverified", "missing_official_domain"))
        .when(redirected, s("conflict", "company_redirect_conflict"))
        .when((F.size(hosts) > 0) & ~only, s("conflict", "official_domain_conflict"))
        .when(filled("display_name").isNull(), s("unverified", "missing_company_profile_name"))
        .when(proof, s("verified", "official_site_identity_link"))
        .when(only & named, s("verified", "profile_domain_and_name"))
        .when(only, s("unverified", "name_or_legal_entity_conflict"))
        .when(named, s("unverified", "name_only_not_identity"))
        .otherwise(s("unverified", "no_domain_evidence"))
    )
    return facts.withColumn("_v", verdict).select(*facts.columns, F.col("_v.status").alias("status"), F.col("_v.reason").alias("reason"), F.lit(POLICY).alias("policy"))


def resolved(records: DataFrame) -> DataFrame:
    """Per slug and board: exactly one verified company wins; more are ambiguous; a refusal or a conflict shows through."""
    verified = F.col("status") == "verified"
    r = records.groupBy("slug", "source").agg(
        F.count_distinct("requested_url").alias("candidates"),
        F.array_sort(F.collect_set(F.when(verified, F.col("company_url")))).alias("urls"),
        F.max(F.when(F.col("status").isin(*REFUSED), F.col("status"))).alias("refused"),
        F.max(F.col("status") == "conflict").alias("conflict"),
        F.min_by("reason", F.when(verified, 0).when(F.col("status") == "conflict", 1).otherwise(2)).alias("why"),
    )
    n = F.size("urls")
    many = F.col("candidates") > MOST_CANDIDATES
    status = F.when(many, "ambiguous").when(n == 1, "verified").when(n > 1, "ambiguous").when(F.col("refused").isNotNull(), F.col("refused")).when(F.col("conflict"), "conflict").otherwise("unverified")
    reason = F.when(many, "identity_candidate_limit").when(n > 1, "several_verified_companies").otherwise(F.col("why"))
    return r.select("slug", "source", status.alias("status"), reason.alias("reason"), F.when(status == "verified", F.col("urls")[0]).alias("company_url"))


def guarded(rows: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Imported rows whose proof binds to the current target, and those in quarantine with why.

    rows: slug, source, policy, status, fingerprint, company_url, stated_company, evidence_kind,
    evidence_source_host, evidence_target, evidence_target_host. current: targets().
    """
    t = current.select("slug", F.col("official_host").alias("_host"), F.col("fingerprint").alias("_print"))
    j = rows.join(t, "slug", "left")
    by_link = F.col("evidence_kind").isin("official_link", "official_same_as") & (F.col("evidence_source_host") == F.col("_host")) & (company_ref("evidence_target", "source") == company_ref("company_url", "source"))
    by_profile = (F.col("evidence_kind") == "profile_website") & (F.col("evidence_target_host") == F.col("_host"))
    why = (
        F.when(~F.col("policy").eqNullSafe(F.lit(POLICY)) | ~F.col("status").eqNullSafe(F.lit("verified")), "not_verified")
        .when(filled("_host").isNull() | ~F.col("fingerprint").eqNullSafe(F.col("_print")), "target_changed")
        .when(company_ref("company_url", "source").isNull() | ~company_ref("stated_company", "source").eqNullSafe(company_ref("company_url", "source")), "company_mismatch")
        .when(~F.coalesce(by_link | by_profile, F.lit(False)), "missing_or_misbound_identity_evidence")
    )
    j = j.withColumn("quarantine_reason", why).drop("_host", "_print")
    return j.where("quarantine_reason is null").drop("quarantine_reason"), j.where("quarantine_reason is not null")


def split_jobs(jobs: Column, allowed: Column, source: Column) -> Column:
    """Jobs of an allowed employer, and the others."""
    mine = lambda j: F.array_contains(allowed, company_ref(j["company_url"], source))
    return F.struct(F.filter(jobs, lambda j: F.coalesce(mine(j), F.lit(False))).alias("good"), F.filter(jobs, lambda j: ~F.coalesce(mine(j), F.lit(False))).alias("bad"))


def retired(contacts: DataFrame, proofs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contacts after an import of proofs (slug, same): those a board gave go into quarantine unless the proof stays the same."""
    p = proofs.select("slug", F.col("same").alias("_same"))
    j = contacts.join(p, "slug", "left").withColumn("_out", (F.col("source") == "linkedin") & (F.col("_same") == F.lit(False)))
    out = F.coalesce("_out", F.lit(False))
    return j.where(~out).drop("_same", "_out"), j.where(out).drop("_same", "_out")
