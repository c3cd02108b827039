"""Row types shared by the operators."""

from __future__ import annotations

AUTHOR = "struct<surname:string,given:string>"
CONFIDENCE = "struct<title:double,authors:double,year:double,venue:double,doi:double>"
FIELDS = f"struct<title:string,authors:array<{AUTHOR}>,et_al:boolean,year:int,venue:string,doi:string,entry_type:string,confidence:{CONFIDENCE}>"
REFERENCE = f"doc_id string, idx int, raw string, source_format string, key string, line int, fields {FIELDS}"
CANDIDATE = (
    "struct<engine:string,title:string,link:string,result_id:string,authors:array<string>,authors_truncated:boolean,year:int,venue:string,"
    "venue_truncated:boolean,source:string,snippet:string,cited_by:bigint,versions:bigint>"
)
#: The part of a stored search response that is read; everything else is pruned while the JSON is parsed.
RESPONSE = (
    "struct<search_metadata:struct<id:string,status:string,created_at:string>,search_parameters:struct<engine:string,q:string,hl:string,num:string,gl:string>,error:string,"
    "organic_results:array<struct<position:int,title:string,result_id:string,link:string,snippet:string,date:string,source:string,"
    "publication_info:struct<summary:string,authors:array<struct<name:string>>>,inline_links:struct<cited_by:struct<total:bigint>,versions:struct<total:bigint>>>>,"
    "knowledge_graph:struct<title:string,type:string,description:string,authors:string,author:string,originally_published:string,publication_date:string,"
    "first_published:string,published:string,date:string,source:struct<name:string,link:string>>>"
)
RESPONSES = "key string, engine string, query string, created timestamp, body string"
EVAL_ROW = (
    "id string, kind string, field string, indian boolean, entry_type string, title string, authors array<array<string>>, year int, venue string, volume string, "
    "issue string, pages string, doi string, arxiv_id string, expected string, perturbation string, source string"
)
