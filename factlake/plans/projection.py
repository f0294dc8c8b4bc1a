"""Facts from nested payloads: a registry of paths is joined with the items of every field, and each path reads its own place.

A payload is JSON: ``{"fields": {name: {"status": ..., "value": ..., "evidence": [...]}}}``. A value is
one item or an array of them; an item may be wrapped as ``{"value": ..., "conditions": [...]}``, tagged
by ``type``, or be a policy with a default and exceptions. The payload is parsed once into a variant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: words in the description of a fee, by kind of fee; the first that fits counts
FEE_WORDS = {"early_repayment": "early|prepay", "insurance": "insur", "application": "applica|review", "disbursement": "disburs|cash", "origination": "originat|grant|issu", "service": "servic|maint"}

_REGISTRY = "field string, tag string, at string, path string, unit string, or_at string, or_unit string, matching string"


def _money(field: str, base: str) -> list[tuple]:
    """Paths of a field that states absolute amounts, multiples of a salary, shares of a property's value or a formula."""
    forms = (("absolute", "$.range.min", "$.range.max", "", "money"), ("salary_multiple", "$.min_multiple", "$.max_multiple", ".salary_multiple", "salary_multiple"), ("property_value_pct", "$.min_pct", "$.max_pct", ".property_value_pct", "percent"))
    out = [(field, tag, at, f"{base}{part}.{end}", unit) for tag, low, high, part, unit in forms for at, end in ((low, "minimum"), (high, "maximum"))]
    return [*out, (field, "formula", "$.formula", f"{base}.formula", "formula")]


def _rate(field: str, base: str) -> list[tuple]:
    return [(field, None, f"$.{at}", f"{base}.{end}", unit) for at, end, unit in (("min", "minimum", "percent"), ("max", "maximum", "percent"), ("formula", "formula", "formula"))]


def path_rules() -> list[tuple]:
    """The paths of all fields: (field, tag of the item, place in it, path, unit, other place, its unit, pattern that the text must match)."""
    plain = {
        "product_name": "identity.product_name", "formal_terms_name": "identity.formal_terms_name", "purpose": "identity.purpose", "repayment_methods": "repayment.method", "eligibility": "eligibility.requirement", "residency": "eligibility.residency",
        "application_channels": "application.channel", "required_documents": "document.required", "special_conditions": "condition.special", "collateral": "collateral.requirement", "collateral_alternatives": "collateral.alternative", "income_verification": "income_verification.required",
        "creditworthiness": "creditworthiness_assessment.required", "property_market": "mortgage.property_market", "property_requirements": "mortgage.property_requirement", "revolving_enabled": "revolving.enabled", "linked_account": "revolving.linked_account_or_card",
    }
    rules = [(field, None, "$", path, None) for field, path in plain.items()]
    rules += [*_money("loan_amount", "amount"), *_money("credit_limit", "revolving.credit_limit"), *_rate("interest_rate", "rate.nominal"), *_rate("effective_rate", "rate.effective")]
    rules += [("variants", None, "$.name", "identity.variant_name", None), ("variants", None, "$.purpose", "identity.variant_purpose", None)]
    rules += [("term", None, f"$.{at}", f"term.{path}", unit) for at, path, unit in (("min_months", "minimum_months", "months"), ("max_months", "maximum_months", "months"), ("indefinite", "indefinite", None), ("end_condition", "end_condition", None))]
    rules += [("age_requirements", None, f"$.{at}", f"eligibility.age.{end}", "years") for at, end in (("min_age", "minimum"), ("max_age", "maximum"))]
    rules += [(field, None, "$", f"mortgage.{base}.{end}_pct", "percent") for field, base in (("down_payment_pct", "down_payment"), ("ltv_pct", "ltv")) for end in ("minimum", "maximum")]
    rules += [("grace_period_days", None, "$", "revolving.grace_period_days", "days")]
    rules = [(*r, None, None, None) for r in rules]
    rules += [("fees", kind, "$.amount", f"fee.{kind}", "money", "$.rate_pct", "percent", None) for kind in (*FEE_WORDS, "other")]
    return [*rules, ("special_conditions", None, "$", "privilege.salary_customer", None, None, None, r"(?i)\b(?:salary|payroll)\b")]


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(path_rules(), _REGISTRY)


def _read_at(v: str, at: str, places: list[str]) -> Column:
    """What stands at the place that a column names, one of ``places``: each is a path of the plan, so none is parsed for a row."""
    out = F.lit(None).cast("variant")
    for place in places:
        out = F.when(F.col(at) == place, F.try_variant_get(v, F.lit(place), "variant")).otherwise(out)
    return out


def fee_kind(description: Column) -> Column:
    out = F.lit("other")
    for kind, words in reversed(FEE_WORDS.items()):
        out = F.when(F.regexp_like(F.lower(description), F.lit(words)), kind).otherwise(out)
    return out


def project_facts(payloads: DataFrame, rules: DataFrame, key: list[str], payload: str = "payload") -> DataFrame:
    """(key, path, status, value, number, unit, currency, basis, conditions, variant_key) of all payloads.

    A field that was not found gives each of its paths once, without a value. Ranges give a minimum and
    a maximum where they are stated, with one variant key for both. The currency is the range's own or that of a
    single currency condition. Payloads that are null or no JSON give nothing. ``rules`` is small and broadcast.
    """
    known = rules.select("field", "at", "or_at").distinct().collect()  # the registry: some 60 rows
    names, places = sorted({r["field"] for r in known}), sorted({p for r in known for p in (r["at"], r["or_at"]) if p})
    raw = lambda v, at, kind="variant": F.try_variant_get(v, F.lit(at), kind)
    stated = lambda c: F.when(~F.is_variant_null(c), F.col(c))
    none = F.array().cast("array<variant>")
    # each step is a column of its own, so that no place is read again by the steps that build on it
    parsed = payloads.select(*key, F.try_parse_json(payload).alias("_doc"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), raw("_doc", f"$.fields.{n}").alias("_f")) for n in names]))
    fields = parsed.select(*key, each.alias("_e")).select(*key, "_e.field", "_e._f").where(F.col("_f").isNotNull() & ~F.is_variant_null("_f"))
    fields = fields.select(*key, "field", raw("_f", "$.status", "string").alias("status"), raw("_f", "$.value").alias("_raw")).withColumn("_value", stated("_raw"))
    fields = fields.withColumns({"_policy": raw("_value", "$.default_required"), "_exceptions": F.coalesce(raw("_value", "$.exceptions", "array<variant>"), none), "_array": raw("_value", "$", "array<variant>")}).withColumn("_policy", F.array_compact(F.array(stated("_policy"))))
    listed = F.coalesce("_array", F.when(F.size("_policy") + F.size("_exceptions") > 0, F.concat("_policy", "_exceptions")), F.array("_value"))
    items = F.when(F.col("status") == "found", F.filter(listed, lambda x: x.isNotNull() & ~F.is_variant_null(x))).otherwise(F.array(F.lit(None).cast("variant")))
    rows = fields.select(*key, "field", "status", F.posexplode(items).alias("_no", "_item"))
    # what an item says for all of its paths is read once, before it meets them
    rows = rows.withColumns({"_raw": raw("_item", "$.value"), "_conditions": F.coalesce(raw("_item", "$.conditions", "array<variant>"), none)}).withColumn("_v", F.coalesce(stated("_raw"), F.col("_item")))
    rows = rows.withColumn("_c", F.transform("_conditions", lambda c: F.struct(*(F.coalesce(raw(c, f"$.{k}", "string"), F.lit("")).alias(k) for k in ("dimension", "operator", "value")))))
    shown = F.array_join(F.array_sort(F.transform("_c", lambda c: F.concat_ws(" ", c["dimension"], c["operator"], c["value"]))), "; ")
    of_condition = F.array_distinct(F.transform(F.filter("_c", lambda c: c["dimension"] == "currency"), lambda c: F.upper(c["value"])))
    lost = F.col("status") != "found"
    rows = rows.withColumns({
        "conditions": shown, "_currencies": of_condition, "_currency": F.coalesce(raw("_v", "$.range.currency", "string"), raw("_v", "$.currency", "string")), "basis": raw("_v", "$.basis", "string"),
        "_described": F.when(F.col("field") == "fees", F.lower(F.coalesce(raw("_v", "$.description", "string"), F.lit("")))), "_type": raw("_v", "$.type", "string"),
    })
    # both ends of a range share the item's key; a lost field has one variant
    variant = F.substring(F.sha2(F.concat_ws("\x1f", "field", F.coalesce(F.to_json("_item"), F.lit("")), "conditions", F.when(lost, "missing").otherwise("")), 256), 1, 24)
    rows = rows.withColumns({"_tag": F.when(F.col("field") == "fees", fee_kind(F.col("_described"))).otherwise(F.col("_type")), "variant_key": variant})
    r = F.broadcast(rules.withColumnRenamed("field", "_field"))
    met = rows.select(*key, "field", "status", "_v", "_tag", "conditions", "_currencies", "_currency", "basis", "variant_key").join(r, (F.col("field") == F.col("_field")) & (lost | F.col("tag").isNull() | (F.col("tag") == F.col("_tag"))))
    out = met.withColumns({"_first": _read_at("_v", "at", places), "_other": F.when(F.col("or_at").isNotNull(), _read_at("_v", "or_at", places))}).withColumns({"_first": stated("_first"), "_other": stated("_other")})
    out = out.withColumns({"_got": F.coalesce("_first", "_other"), "unit": F.when(F.col("_first").isNotNull() | F.col("or_unit").isNull(), F.col("unit")).otherwise(F.col("or_unit"))})
    out = out.withColumn("value", F.coalesce(raw("_got", "$", "string"), F.to_json("_got"))).where(lost | (F.col("value").isNotNull() & (F.col("matching").isNull() | F.regexp_like("value", F.col("matching")))))
    currency = F.coalesce("_currency", F.when(F.col("unit").isin("percent", "formula") & (F.size("_currencies") == 1), F.get("_currencies", F.lit(0))))
    number = F.when(F.col("unit").isNotNull() & (F.col("unit") != "formula"), raw("_got", "$", "decimal(38,6)"))
    return out.select(*key, "path", "status", "value", number.alias("number"), F.when(~lost, F.col("unit")).alias("unit"), currency.alias("currency"), "basis", "conditions", "variant_key")


#: paths whose numbers can be ranked: those with a unit, without formulas and fees that have no kind
def rankable_paths() -> set[str]:
    return {r[3] for r in path_rules() if r[4] not in (None, "formula") and r[3] != "fee.other"}


def comparison_reason(left: str, right: str, rankable: Column) -> Column:
    """The first of nine reasons why two measures (path, number, unit, currency, basis, scope, conditions) cannot share a ranking; null where they can.

    ``rankable`` says whether the left path can be ranked. Conditions are arrays and compare as sets.
    """
    a, b = (lambda c: F.col(f"{left}.{c}")), (lambda c: F.col(f"{right}.{c}"))
    differ = lambda c: ~a(c).eqNullSafe(b(c))
    as_set = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))
    return (
        F.when(differ("path"), "different_field")
        .when(a("path") == "fee.other", "unclassified_fee")
        .when(~rankable, "unsupported_field")
        .when(a("number").isNull() | b("number").isNull(), "missing_number")
        .when(differ("unit"), "different_unit")
        .when(differ("currency"), "different_currency")
        .when(differ("basis"), "different_rate_basis")
        .when(differ("scope"), "different_fee_scope")
        .when(as_set(a("conditions")) != as_set(b("conditions")), "different_conditions")
    )
