"""Table schemas and value sets of the review dataflow."""

from __future__ import annotations

from pyspark.sql import types as T

LINES = "paper_id string, line_no int, text string, page int, size double, bold boolean, x0 double, y0 double"
PAPERS = "paper_id string, path string, page_count int, body_size double, metadata map<string,string>"
SECTIONS = "paper_id string, section_idx int, number string, title string, label string, kind string, text string, start_page int, end_page int"
CAPTIONS = "paper_id string, kind string, id string, caption string, page int, referenced_in_text boolean"
CITING = "array<struct<quote:string,location:string>>"
REFERENCES = f"paper_id string, ref_index int, raw string, doi string, title string, year string, authors array<string>, citing_sentences {CITING}"
CANDIDATES = "paper_id string, section_idx int, token string, sentence string, location string, suggestion string, occurrences bigint"
FINDINGS = "paper_id string, ord bigint, severity string, category string, location string, quote string, description string, correction string, source_pass string, verdict string, url string, stability string"
BIB_RECORDS = "found boolean, url string, title string, authors array<string>, year string, venue string, doi string, type string, is_retracted boolean, retraction_notes string, is_preprint boolean, abstract string, match_score double, source string"
SEARCH_RESULTS = "query string, rank int, title string, url string, snippet string"
CALLS = "run_id string, pass string, label string, model string, mode string, ok boolean, attempts int, duration_s double, usage map<string,bigint>, error string"
RUNS = "run_id string, paper string, started_at string, provider string, model string, quantization string, prompt_version string, seed int, temperature double, repeats int, search_tool_available boolean, passes_run array<string>, duration_s double, total_usage map<string,bigint>, errors int"
JOB_EVENTS = "job_id string, offset bigint, status string, message string, ts timestamp"

#: The value sets of model replies.
SEVERITIES = ("critical", "major", "minor")
VERDICTS = ("verified_correct", "verified_incorrect", "could_not_verify")
CLAIM_VERDICTS = ("supported", "overreach", "unsupported")
REFERENCE_STATUSES = ("verified", "metadata_mismatch", "not_found", "retracted", "could_not_verify")
SUPPORTS = ("yes", "weaker", "different", "unrelated", "could_not_check")
TRIAGE = ("typo", "domain_term", "inconsistent")
STABILITIES = ("stable", "unstable", "single_run")
MECHANICAL_CATEGORIES = ("language", "grammar", "terminology", "notation", "figure_table")
CONSISTENCY_CATEGORIES = ("numbers", "claims", "alignment", "statistics", "reproducibility")

#: Reply schemas of the calls, as nested Spark types, in the order of their fields.
REPLIES = {
    "pass0": "struct<limitations:array<string>,language:string,title:string,sections:array<struct<number:string,title:string,pages:string>>,research_questions_or_hypotheses:array<string>,figures:array<struct<id:string,caption:string,referenced_in_text:boolean>>,tables:array<struct<id:string,caption:string,referenced_in_text:boolean>>,key_numbers:array<struct<value:string,meaning:string,locations:array<string>>>,bibliography:array<struct<index:int,raw:string>>>",
    "pass1": "struct<limitations:array<string>,section:string,spellcheck_triage:array<struct<token:string,classification:string,correction:string,quote:string,location:string>>,findings:array<struct<severity:string,category:string,location:string,quote:string,description:string,correction:string>>>",
    "pass2": "struct<limitations:array<string>,number_checks:array<struct<quantity:string,locations:array<string>,values:array<string>,recomputation:string,verdict:string>>,claim_checks:array<struct<claim_quote:string,location:string,supporting_evidence:string,verdict:string,explanation:string>>,research_question_alignment:array<struct<question:string,what_was_actually_tested:string,gap:string>>,findings:array<struct<severity:string,category:string,location:string,quote:string,description:string>>>",
    "pass3": "struct<limitations:array<string>,search_tool_available:boolean,references:array<struct<index:int,raw:string,status:string,found_at:string,mismatch_details:string,citing_sentences:array<struct<quote:string,location:string>>,supports_claim:string,notes:string>>,missing_citations:array<struct<quote:string,location:string,why_needed:string>>>",
    "pass4_claims": "struct<limitations:array<string>,claims:array<struct<claim_quote:string,location:string,search_query:string>>,main_result_query:string>",
    "pass4": "struct<limitations:array<string>,search_tool_available:boolean,fact_checks:array<struct<claim_quote:string,location:string,source_url:string,source_says:string,verdict:string>>,missing_engagement:array<struct<work:string,url:string,why_relevant:string>>>",
}
#: The list in a reply whose objects a field stands in, and the field: the values that it takes, of which the second part is the one
#: that an absent field has. Findings of pass 1 alone have a correction.
ALLOWED = {
    ("spellcheck_triage", "classification"): (TRIAGE, "domain_term"),
    ("number_checks", "verdict"): (VERDICTS, "could_not_verify"),
    ("claim_checks", "verdict"): (CLAIM_VERDICTS, "supported"),
    ("references", "status"): (REFERENCE_STATUSES, "could_not_verify"),
    ("references", "supports_claim"): (SUPPORTS, "could_not_check"),
    ("fact_checks", "verdict"): (VERDICTS, "could_not_verify"),
    ("findings", "severity"): (SEVERITIES, "major"),
    ("findings", "category"): (CONSISTENCY_CATEGORIES, "numbers"),
    ("corrected", "severity"): (SEVERITIES[1:], "minor"),
    ("corrected", "category"): (MECHANICAL_CATEGORIES, "language"),
}


def allowed(parent: str, name: str, siblings: list[str]) -> tuple[tuple[str, ...], str] | None:
    """Which values a string field of a reply takes, and its default; None if it takes any."""
    return ALLOWED.get(("corrected" if parent == "findings" and "correction" in siblings else parent, name))


def struct(ddl: str) -> T.StructType:
    """A StructType from a DDL string, with or without the outer struct<>."""
    return T.StructType.fromDDL(ddl[7:-1] if ddl.startswith("struct<") else ddl)
