"""Keys, labels and kinds of organisation and person names."""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that do not tell two names apart: fixed values.
SUFFIXES = ("ltd", "limited", "inc", "incorporated", "corp", "corporation", "company", "co", "the", "of", "and")

# The words and phrases that tell the kinds of names apart.
PUBLIC_BODIES_AT_START = ("city of vancouver", "the city of vancouver", "school district")
PUBLIC_BODIES = (
    "bc housing", "british columbia housing management commission", "provincial rental housing corp", "vancouver public housing corp", "vancouver affordable housing agency",
    "metro vancouver housing", "his majesty", "her majesty", "government of canada", "canada mortgage and housing", "board of parks and recreation",
)
PROVINCE = "province of british columbia"
COOP_WORDS = ("coop", "cooperative")  # also with a dash after "co"
CORPORATE_ENDS = ("ltd", "limited", "inc", "incorporated", "corp", "corporation")
SOCIETY_WORDS = ("society", "association")
CHARITY_WORDS = (
    "society", "societe", "foundation", "association", "church", "parish", "diocese", "synod", "mission", "ministry", "ministries", "habitation",
    "ywca", "ymca", "benevolent", "benevolence", "legion",
)
PARTNERSHIP_ENDS = ("partnership", "lp", "l p")
COMPANY_WORDS = (
    *CORPORATE_ENDS, "company", "holding", "holdings", "properties", "investment", "investments", "enterprises", "development", "developments", "realty",
    "assurance", "insurance", "bank", "reit", "ulc", "group", "management", "ventures", "apartments", "hotel", "gp",
)
PLACE_WORDS = (
    "housing", "community", "service", "services", "centre", "center", "council", "club", "fund", "residence", "residences", "estate", "estates", "place", "court",
    "manor", "tower", "towers", "villa", "alley", "lodge", "house", "home", "homes", "rental", "rentals", "living", "wealth", "capital",
)


@F.pandas_udf(StringType())
def _decomposed(names: pd.Series) -> pd.Series:
    return names.map(lambda x: unicodedata.normalize("NFKD", x), na_action="ignore")


def owner_key(c: Column, ascii_only: bool = False) -> Column:
    """Letters and digits with dashes between; Unicode decomposition, for which Spark has no function, goes through Arrow."""
    lowered = F.lower(c)
    text = lowered if ascii_only else _decomposed(lowered)
    key = F.regexp_replace(F.regexp_replace(text, r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.coalesce(F.nullif(key, F.lit("")), F.lit("unknown"))


def match_key(c: Column) -> Column:
    """Words without company suffixes and plural s, joined."""
    words = F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9]+)"), 1), lambda w: ~w.isin(*SUFFIXES))
    return F.array_join(F.transform(words, lambda w: F.when((F.length(w) > 3) & w.endswith("s"), F.regexp_replace(w, "s$", "")).otherwise(w)), "")


def same_entity(a: Column, b: Column, cluster_a: Column, cluster_b: Column) -> Column:
    return F.coalesce((match_key(a) == match_key(b)) | (cluster_a == cluster_b), F.lit(False))


def owner_label(c: Column) -> Column:
    """A list written as text, of names in quotes or of numbers, becomes its items; quotes and brackets around one name go.

    A list of nothing, and blanks, are ``(Unknown)``.  A list that is not written out properly stays as it is.
    """
    s = F.trim(c)
    item = r"""(?:'[^']*'|"[^"]*"|-?[0-9]+(?:\.[0-9]+)?)"""
    items = F.regexp_extract_all(s, F.lit(f"({item})"), 1)
    several = s.rlike(rf"^\[\s*(?:{item}\s*(?:,\s*{item}\s*)*+,?\s*)?\]$|^\(\s*(?:{item}\s*,\s*(?:{item}\s*(?:,\s*{item}\s*)*+,?\s*)?)?\)$")
    joined = F.array_join(F.filter(F.transform(items, lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"""^['"]|['"]$""", "")), r"""^['"]+|['"]+$""", "")), lambda x: x != ""), ", ")
    bare = F.trim(F.regexp_replace(s, r"""^\(\s*(?:'([^']*)'|"([^"]*)")\s*\)$""", "$1$2"))
    unquoted = F.trim(F.regexp_replace(bare, r"""(?s)^['"](.*)['"]$""", "$1"))
    plain = F.trim(F.regexp_replace(unquoted, r"^\[([^,]*)\]$", "$1"))
    return F.coalesce(F.nullif(F.when(several, joined).otherwise(plain), F.lit("")), F.lit("(Unknown)"))


def sector(c: Column) -> Column:
    """The sector that a damaged label ends with, with at most two stray letters before it."""
    letters = F.regexp_replace(F.lower(c), r"[^a-z]", "")
    out = F.lit(None).cast("string")
    for name in ("private", "government", "nonprofit", "chineseassociation"):
        out = F.when(letters.endswith(name) & (F.length(letters) - len(name) <= 2), name).otherwise(out)
    return out


def kind_of_name(c: Column) -> Column:
    """The kind of body or person that a name looks like; ``unknown`` where nothing tells.

    The name becomes a text of its words between single blanks, in which words and phrases are looked up; so a rule is
    a list of words, and its place in the chain.
    """
    name = F.trim(F.coalesce(c, F.lit("")))
    undashed = F.regexp_replace(F.lower(name), r"\bco-(?=op(?:erative)?\b)", "co")
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(undashed, "[^a-z0-9]+", " ")), F.lit(" "))
    holds = lambda listed: reduce(or_, (F.contains(words, F.lit(f" {w} ")) for w in listed))
    ends = lambda listed: reduce(or_, (F.endswith(words, F.lit(f" {w} ")) for w in listed))
    begins = lambda listed: reduce(or_, (F.startswith(words, F.lit(f" {w} ")) for w in listed))
    public = begins(PUBLIC_BODIES_AT_START) | (words == f" {PROVINCE} ") | reduce(or_, (F.contains(words, F.lit(f" {w}")) for w in PUBLIC_BODIES))
    number = F.regexp_extract(words, r"^ (\d{6,}) ?", 1)
    after = F.ltrim(F.substr(words, F.length(number) + 2))
    numbered = (number != "") & reduce(or_, (after.startswith(f"{place} {end}") for place in ("bc", "b c", "british columbia") for end in ("ltd", "limited", "inc", "corp")))
    turned = F.split(name, ", ")  # as registers file people: surname, given names
    filed = (F.size(turned) == 2) & F.get(turned, F.lit(0)).rlike(r"^[A-Za-z' -]+$") & F.get(turned, F.lit(1)).rlike(r"^[A-Za-z' .-]+$")
    plain = name.rlike(r"^[A-Za-z'. -]+$") & F.size(F.split(name, " ")).between(2, 4)
    return (
        F.when(public, "government")
        .when(holds(COOP_WORDS), "coop")
        .when(numbered, "numbered_company")
        .when(ends(CORPORATE_ENDS) & ~holds(SOCIETY_WORDS), "company")
        .when(holds(CHARITY_WORDS), "non_profit")
        .when(ends(PARTNERSHIP_ENDS), "partnership")
        .when(holds(["trust company"]), "company")
        .when(holds(["trust"]), "trust")
        .when(holds(COMPANY_WORDS), "company")
        .when(filed | (plain & ~holds(PLACE_WORDS)), "individual")
        .otherwise("unknown")
    )


def first_rule(c: Column, rules, default: str = "unknown") -> Column:
    """The name of the first of the rules (name, pattern) that is found; case does not matter."""
    name, out = F.trim(F.coalesce(c, F.lit(""))), None
    for kind, pattern in rules:
        hit = name.rlike("(?i)" + pattern)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise(default)


def classified(names: DataFrame, claims: DataFrame, registry: DataFrame, institutional: DataFrame) -> DataFrame:
    """Adds (kind, basis, inferred, institutional) to each (name, key): claims beat the registry, the registry the name.

    claims: (key, kind, source), the latest of each key; registry: (key, holder_type); institutional: (key, label).
    A registry's individual is one; its corporation is a company unless the name says something better.
    """
    holder = registry.where("key is not null and holder_type is not null").groupBy("key").agg(
        F.max_by("holder_type", F.struct((F.col("holder_type") != "INDIVIDUAL").cast("int"), "holder_type")).alias("_holder")
    )
    one = claims.groupBy("key").agg(F.max_by(F.struct("kind", "source"), F.struct("kind", "source")).alias("_claim"))
    label = institutional.groupBy("key").agg(F.max("label").alias("institutional"))
    rows = names.join(one, "key", "left").join(holder, "key", "left").join(label, "key", "left").withColumn("_named", kind_of_name(F.col("name")))
    is_person = F.col("_holder") == "INDIVIDUAL"
    is_body = F.col("_holder").isNotNull() & ~is_person & F.col("_named").isin("individual", "unknown")
    basis = F.when(F.col("_claim.source") == "public_registry", "claim_registry").when(F.col("_claim.source") == "city_record", "claim_city_records").otherwise("claim_research")
    claimed = F.col("_claim").isNotNull()
    return rows.select(
        *names.columns,
        F.when(claimed, F.col("_claim.kind")).when(is_person, "individual").when(is_body, "company").otherwise(F.col("_named")).alias("kind"),
        F.when(claimed, basis).when(is_person | is_body, "registry").otherwise("name_rule").alias("basis"),
        (~claimed & ~F.coalesce(is_person | is_body, F.lit(False))).alias("inferred"),
        "institutional",
    )
