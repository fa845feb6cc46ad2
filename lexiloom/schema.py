"""The nested token model: one row per window, an array of cohorts, each an array of readings.

``hidden`` is a cohort's list of ignored readings.  A window's row holds all it
needs, so whatever works on windows needs no shuffle; documents are the key for
what crosses windows.
"""

from __future__ import annotations

from pyspark.sql import types as T

SUB = "struct<tags:array<string>,mapping:string>"
READING = (
    f"struct<rno:int,tags:array<string>,mapping:string,mapped:boolean,noprint:boolean,immutable:boolean,hit_by:array<int>,subs:array<{SUB}>>"
)
COHORT = (
    "struct<gid:bigint,wordform:string,static_tags:array<string>,dep_self:bigint,dep_parent:bigint,"
    "relations:map<string,array<bigint>>,text:string,wblank:string,removed:boolean,"
    f"readings:array<{READING}>,deleted:array<{READING}>,delayed:array<{READING}>,hidden:array<{READING}>>"
)
WINDOW = (
    f"doc_id bigint, win int, text string, text_post string, flush_after boolean, vars_set map<string,string>, vars_rem array<string>, cohorts array<{COHORT}>"
)


def window_schema() -> T.StructType:
    return T._parse_datatype_string(WINDOW)


FIELDS = ["doc_id", "win", "text", "text_post", "flush_after", "vars_set", "vars_rem", "cohorts"]
