"""Rules on the wording of reports, line by line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The wording that the rules look for.
GROUPS = r"race|racial|ethnicity|ethnic|hispanic|latino|latina|latinx|black|white|asian|indigenous|native american|african american|minority|minorities|people of color|poc"
CAUSES_BEFORE = r"because|due to|caused by|driven by|attributable to|explained by|result of|owing to|leads? to|results? in|causes?"
CAUSES_AFTER = r"causes?|drives?|leads? to|results? in|explains?|determines?|predicts?|accounts? for"
DESCRIPTIVE = r"disproportionately affect|disproportionate|more likely|less likely|higher rates? among|lower rates? among|concentrated among|predominantly|largely|mostly|majority|correlated with|associated with|compared to"
NEGATION = r"not|no|contrary|contrary to|opposite|contradicts?|disproves?|challenges?|unexpected|surprising|counter|lower than expected|higher than expected|less than expected|more than expected"
POLICY = r"should|must|recommend|recommends?|ought to|urge|urges?|call for|calls? for|propose|proposes?|advocate|advocates?|suggest|suggests? that (?:the county|the city|the state|officials?|policymakers?)"
DISCLAIMER = r"note|disclaimer|caveat|caution|limitation|based on|subject to|contingent|pending|further analysis|additional research|not a substitute|for informational|not policy advice|consult"
SUPERLATIVE = r"worst|best|most|highest|lowest|greatest|least|largest|smallest|most severe|most concentrated|most affected|most underserved|number one|#1|top-ranked|bottom-ranked"
CITATION = r"(\([^)]{3,}\)|\[\d+\]|according to|per the|data show|data shows|figure \d|table \d|see appendix|as shown|source:|\d{4} [A-Z])"
HEDGE = r"may suggest|seem(s)? to (indicate|suggest|imply|show)|might suggest|could suggest|appears? to (indicate|suggest)|tends? to suggest|would seem to|seems? like|seems? as though|might indicate|may indicate|could indicate|could imply|may imply"
KEY_HEADING = r"(?i)^#+\s*(key finding|finding|conclusion|summary|result|hero|executive)"


def _words(pattern: str) -> str:
    return rf"(?i)\b({pattern})\b"


def scan_report(docs: DataFrame, key: str, text: str, topics: Sequence[str] = (), hero: str = "", beliefs: Sequence[str] = ()) -> DataFrame:
    """``(key, line_no, rule, severity, matched, in_key_section)``: each rule that a line (from 1) meets.

    * ``sensitive_topic`` (WARN): the first of the brief's ``topics`` in the line.
    * ``hero_contradicts_belief`` (WARN): a word of the ``hero`` finding of five letters or
      more and a negation, if the brief has a finding and ``beliefs``.
    * ``race_causal_language`` (FAIL): a group within 60 characters of a cause, before or
      after it in one sentence, unless the line is descriptive.
    * ``policy_without_disclaimer`` (WARN): a policy verb without a disclaimer within three lines.
    * ``superlative_without_citation`` (WARN): none in the line or the next.
    * ``passive_uncertainty`` (INFO): hedged wording; ``in_key_section`` tells whether a
      heading of findings has come by then.

    A line may meet several rules. Null texts have no lines; no topics, no hero finding
    or no beliefs leave their rule out.
    """
    lines = docs.where(F.col(text).isNotNull()).select(F.col(key), F.posexplode(F.split(F.col(text), "\n")).alias("_i", "_line"))
    w = Window.partitionBy(key).orderBy("_i")
    near = F.array_join(F.collect_list("_line").over(w.rowsBetween(-3, 3)), " ")
    begun = F.max(F.col("_line").rlike(KEY_HEADING)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = lines.withColumns({"_near": near, "_two": F.concat_ws(" ", "_line", F.lead("_line").over(w)), "_begun": begun})
    line, low = F.col("_line"), F.lower("_line")
    found = lambda pattern: F.regexp_extract(line, pattern, 0)

    def rule(name: str, severity: str, hit: Column, matched: Column | None = None, section: Column | None = None) -> Column:
        none = F.lit(None)
        return F.when(hit, F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), (none if matched is None else matched).cast("string").alias("matched"), (none if section is None else section).cast("boolean").alias("in_key_section")))

    before, after = rf"(?i)\b({CAUSES_BEFORE})\b[^.]{{0,60}}\b({GROUPS})\b", rf"(?i)\b({GROUPS})\b[^.]{{0,60}}\b({CAUSES_AFTER})\b"
    rules = [
        rule("race_causal_language", "FAIL", (line.rlike(before) | line.rlike(after)) & ~line.rlike(_words(DESCRIPTIVE)), F.when(line.rlike(before), found(before)).otherwise(found(after))),
        rule("policy_without_disclaimer", "WARN", line.rlike(_words(POLICY)) & ~F.col("_near").rlike(_words(DISCLAIMER))),
        rule("superlative_without_citation", "WARN", line.rlike(_words(SUPERLATIVE)) & ~F.col("_two").rlike(f"(?i){CITATION}"), found(_words(SUPERLATIVE))),
        rule("passive_uncertainty", "INFO", line.rlike(_words(HEDGE)), found(_words(HEDGE)), F.col("_begun")),
    ]
    if topics:
        topic = F.coalesce(*(F.when(F.contains(low, F.lit(t.lower())), F.lit(t)) for t in topics))
        rules.append(rule("sensitive_topic", "WARN", topic.isNotNull(), topic))
    if hero and beliefs:
        words = F.array(*map(F.lit, sorted({x for x in hero.lower().split() if len(x) > 4}))).cast("array<string>")
        rules.append(rule("hero_contradicts_belief", "WARN", F.arrays_overlap(F.split(F.trim(low), r"\s+"), words) & line.rlike(_words(NEGATION))))
    return rows.select(key, (F.col("_i") + 1).alias("line_no"), F.explode(F.array_compact(F.array(*rules))).alias("r")).select(key, "line_no", "r.*")


def report_status(hits: DataFrame, key: str) -> DataFrame:
    """``(key, fails, warns, infos, status)``: FAIL with any failure, else WARN with any warning, else PASS."""
    n = lambda s: F.count_if(F.col("severity") == s)
    out = hits.groupBy(key).agg(n("FAIL").alias("fails"), n("WARN").alias("warns"), n("INFO").alias("infos"))
    return out.withColumn("status", F.when(F.col("fails") > 0, "FAIL").when(F.col("warns") > 0, "WARN").otherwise("PASS"))
