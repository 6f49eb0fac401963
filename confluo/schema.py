"""Frame schemas: partial records as sources give them, canonical records as the merge makes them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tracked(kind: str = "string") -> str:
    """A value with its provenance."""
    return f"struct<value:{kind},source:string,confidence:double,extraction_method:string>"


S, D = tracked(), tracked("double")
LOCATION = f"struct<city:{S},region:{S},country:{S}>"
LINKS = f"struct<linkedin:{S},github:{S},portfolio:{S},other:array<{S}>>"
PARTIAL_EXPERIENCE = f"struct<company:{S},title:{S},date_range:{S},summary:{S}>"
PARTIAL_EDUCATION = f"struct<institution:{S},degree:{S},field:{S},year:{S}>"
SKILL = "struct<name:string,confidence:double,sources:array<string>>"
EXPERIENCE = "struct<company:string,title:string,start:string,end:string,summary:string>"
EDUCATION = "struct<institution:string,degree:string,field:string,end_year:int>"
PROVENANCE = "struct<field:string,source:string,method:string>"

PARTIAL_FIELDS = {
    "record_idx": "bigint",
    "source": "string",
    "full_name": S,
    "emails": f"array<{S}>",
    "phones": f"array<{S}>",
    "location": LOCATION,
    "links": LINKS,
    "headline": S,
    "years_experience": D,
    "skills": f"array<{S}>",
    "experience": f"array<{PARTIAL_EXPERIENCE}>",
    "education": f"array<{PARTIAL_EDUCATION}>",
}
CANONICAL_FIELDS = {
    "candidate_id": S,
    "full_name": S,
    "emails": f"array<{S}>",
    "phones": f"array<{S}>",
    "location": LOCATION,
    "links": LINKS,
    "headline": S,
    "years_experience": D,
    "skills": f"array<{SKILL}>",
    "experience": f"array<{EXPERIENCE}>",
    "education": f"array<{EDUCATION}>",
    "provenance": f"array<{PROVENANCE}>",
    "overall_confidence": "double",
}


def ddl(fields: dict[str, str]) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in fields.items()))


def carrier(value: Column, source: Column | str, confidence: float, method: str, kind: str = "string") -> Column:
    """A tracked value, or null where the value is null."""
    source = F.lit(source) if isinstance(source, str) else source
    made = F.struct(value.alias("value"), source.alias("source"), F.lit(confidence).alias("confidence"), F.lit(method).alias("extraction_method"))
    return F.when(value.isNotNull(), made).cast(tracked(kind))


def complete(columns: dict[str, Column]) -> list[Column]:
    """All columns of a partial record, in order: unknown scalars null, unknown collections empty."""
    out = []
    for name, kind in PARTIAL_FIELDS.items():
        if name in columns:
            value = columns[name]
        elif kind.startswith("array"):
            value = F.array()
        elif name == "location":
            value = F.struct(*[F.lit(None).cast(S).alias(x) for x in ("city", "region", "country")])
        elif name == "links":
            value = F.struct(*[F.lit(None).cast(S).alias(x) for x in ("linkedin", "github", "portfolio")], F.array().cast(f"array<{S}>").alias("other"))
        else:
            value = F.lit(None)
        out.append(value.cast(kind).alias(name))
    return out
