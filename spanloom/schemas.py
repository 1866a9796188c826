"""The one definition of every table's columns."""

from __future__ import annotations

SPAN = "trace_id string, span_id string, parent_span_id string, name string, kind string, start_time timestamp, end_time timestamp, status struct<code:string,message:string>, attributes map<string,string>, events array<struct<name:string,time:timestamp,attributes:map<string,string>>>, resource map<string,string>, links array<struct<trace_id:string,span_id:string>>"
CONTEXT = "span_id string, trace_id string, run_id string, workflow string, step string, item string, start_time timestamp"
SECTIONS = "array<struct<id:string,version:string,start:int,end:int>>"
FLOW_STEPS = "run_id string, workflow string, step string, item string, kind string, status string, attempt int, attempts int, attempt_statuses array<string>, reused_from string, fork_of string, run_seed long, review_decisions array<struct<decision:string,actor_kind:string>>, review_note_present int, error string, start_time timestamp, duration_ms double"
AFFECTED = "finding_key string, span_id string, run_id string, start_time timestamp"
EMBEDDINGS = "model string, text_sha string, embedding array<double>"
