"""Extracted relations: parsing model replies and validating what they claim."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalised, trim_controls

# Relation types that may be stored, those accepted without review, and entry types.
RELATION_TYPES = ("defines", "belongs_to", "references", "causes", "parent_of", "child_of", "synonym_of", "applies_when", "depends_on", "conflicts_with")
SAFE_TYPES = ("defines", "belongs_to", "references", "synonym_of")
ENTRY_TYPES = ("concept", "entity", "thesis", "methodology", "finding", "comparison", "synthesis", "source", "query")

_RELATION = "struct<sourceTitle:string,targetTitle:string,relationType:string,evidence:string,confidence:double,reason:string>"


def json_payload(reply: Column) -> Column:
    """The outermost JSON object or array of a reply, whichever begins first; code fences and chatter are cut off."""
    t = trim_controls(F.coalesce(reply, F.lit("")))
    array_first = t.rlike(r"^[^{]*\[")
    return F.when(array_first, F.regexp_extract(t, r"(?s)(\[.*\])", 1)).otherwise(F.regexp_extract(t, r"(?s)(\{.*\})", 1))


def readable(reply: Column) -> Column:
    """Whether a reply holds JSON that can be parsed."""
    return F.coalesce(F.try_parse_json(F.nullif(json_payload(reply), F.lit(""))).isNotNull(), F.lit(False))


def parse_relations(reply: Column) -> Column:
    """array of relation structs from an object with `relations` or a bare array; missing fields are '' and 0."""
    body = json_payload(reply)
    listed = F.when(body.startswith("["), F.from_json(body, f"array<{_RELATION}>")).otherwise(F.from_json(body, f"struct<relations:array<{_RELATION}>>")["relations"])
    text = lambda c: trim_controls(F.coalesce(c, F.lit("")))
    names = ("sourceTitle", "targetTitle", "relationType", "evidence")
    return F.transform(
        F.coalesce(listed, F.array().cast(f"array<{_RELATION}>")),
        lambda r: F.struct(*[text(r[n]).alias(n) for n in names], F.coalesce(r["confidence"], F.lit(0.0)).alias("confidence"), text(r["reason"]).alias("reason")),
    )


def relation_type(c: Column) -> Column:
    return F.replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit("-"), F.lit("_"))


def evidence_found(evidence: Column, *contents: Column) -> Column:
    """Whether the evidence stands in one of the texts, both normalised."""
    e = normalised(evidence)
    found = F.lit(False)
    for c in contents:
        found = found | F.contains(normalised(c), e)
    return (e != "") & found


def relation_errors(raw_type: Column, evidence: Column, source_ok: Column, source_id: Column, target_id: Column, source_text: Column, target_text: Column) -> Column:
    """Codes of all rules that a relation breaks, in the order of the rules."""
    blank = F.trim(F.coalesce(evidence, F.lit(""))) == ""
    code = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), F.lit(name))
    codes = F.array(
        code(~source_ok, "source_mismatch"),
        code(target_id.isNull(), "target_not_found"),
        code(target_id == source_id, "self_relation"),
        code(~relation_type(raw_type).isin(*RELATION_TYPES), "unsupported_relation_type"),
        code(blank, "missing_evidence"),
        code(~blank & ~evidence_found(evidence, source_text, target_text), "evidence_not_found"),
    )
    return F.filter(codes, lambda x: x.isNotNull())


def relation_status(confidence: Column, kind: Column, errors: Column, reject: float = 0.65, accept: float = 0.82) -> Column:
    """rejected with errors or low confidence, accepted for safe types at high confidence, else pending; NaN is pending."""
    known = ~F.isnan(confidence)
    return (
        F.when((F.size(errors) > 0) | (known & (confidence < reject)), "rejected")
        .when(known & (confidence >= accept) & kind.isin(*SAFE_TYPES), "accepted")
        .otherwise("pending")
    )


def with_errors(reason: Column, errors: Column) -> Column:
    """The reason followed by the error codes, if there are any."""
    r = F.coalesce(reason, F.lit(""))
    head = F.when(F.trim(r) == "", "").otherwise(F.concat(r, F.lit("\n")))
    return F.when(F.size(errors) == 0, r).otherwise(F.concat(head, F.lit("validation_errors="), F.array_join(errors, ",")))


_ENTRY = "struct<title:string,type:string,entry_type:string,content:string,description:string,tags:array<string>,keywords:string,related:array<string>>"


def parse_entries(reply: Column) -> Column:
    """array of entry structs from a JSON array: types outside the list become concept, tags a comma list; a bad reply gives none."""
    rows = F.coalesce(F.from_json(json_payload(reply), f"array<{_ENTRY}>"), F.array().cast(f"array<{_ENTRY}>"))

    def entry(e: Column) -> Column:
        kind = F.lower(F.coalesce(e["type"], e["entry_type"], F.lit("concept")))
        related = F.filter(F.transform(e["related"], lambda r: F.trim(r)), lambda r: (r != "") & ~F.lower(r).isin("none", "null"))
        return F.struct(
            F.coalesce(e["title"], F.lit("未命名词条")).alias("title"),
            F.when(kind.isin(*ENTRY_TYPES), kind).otherwise("concept").alias("entry_type"),
            F.coalesce(e["content"], F.lit("")).alias("content"),
            F.coalesce(e["description"], F.lit("")).alias("description"),
            F.coalesce(F.array_join(e["tags"], ","), e["keywords"], F.lit("")).alias("keywords"),
            F.nullif(F.array_join(related, ","), F.lit("")).alias("related"),
            F.lit(0.85).alias("confidence"),
        )

    return F.transform(rows, entry)


def json_strings(c: Column, fallback: Column) -> Column:
    """A JSON array of strings; `fallback` where it is null, malformed or no array."""
    return F.coalesce(F.from_json(json_payload(c), "array<string>"), fallback)


def reply_text(body: Column) -> Column:
    """Reply text of a chat response, or its error message, or ''."""
    return F.coalesce(F.get_json_object(body, "$.choices[0].message.content"), F.get_json_object(body, "$.content[0].text"), F.get_json_object(body, "$.error.message"), F.lit(""))


# A document's class where the model's reply does not state it.
CLASS_DEFAULTS = {"categoryL1": "其他", "docType": "report", "library": "report", "reason": "AI分析完成"}
FAILED_REASON = "AI分析失败"


def classification(reply: Column) -> Column:
    """struct of CLASS_DEFAULTS' fields from a JSON object, fenced or not; absent fields and unreadable replies have the defaults, the latter with a reason that says so."""
    body = F.regexp_replace(F.regexp_replace(F.trim(reply), r"^```\w*\n?", ""), r"\n?```$", "")
    read = F.from_json(body, "map<string,string>", {"mode": "PERMISSIVE"})
    failed = F.struct(*[F.lit(FAILED_REASON if k == "reason" else v).alias(k) for k, v in CLASS_DEFAULTS.items()])
    found = F.struct(*[F.when(F.map_contains_key(read, k), F.coalesce(read[k], F.lit("null"))).otherwise(v).alias(k) for k, v in CLASS_DEFAULTS.items()])
    return F.when(read.isNull(), failed).otherwise(found)
