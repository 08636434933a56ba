"""Judgment frames and decisions over briefings made of events: one record pair an event, facts by its number."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlight.operators import frames as J
from cairnlight.plans.registry import query, table

_ASSESSMENT = """'{"assessment_id":"a' || event_id || '","decision":"' || CASE event_id % 9 WHEN 0 THEN 'reject' WHEN 1 THEN 'escalate' WHEN 2 THEN 'defer' ELSE 'accept' END
 || '","refresh_request":{"needed":' || CASE WHEN event_id % 7 = 0 THEN '"yes"' ELSE '0' END || '},"admissibility":{"high_uncertainty":' || CASE WHEN event_id % 11 = 0 THEN 'true' ELSE 'null' END || '}}'"""
_BRIEFING = """'{"relation_scope":{"belief_id":"b' || user_id || '","legacy_whole_belief_reader":{"kernel_relation":"' || CASE event_id % 5 WHEN 0 THEN 'Supports' WHEN 1 THEN 'challenge' WHEN 2 THEN 'mixed' WHEN 3 THEN 'unknown' ELSE 'off-topic' END
 || '"},"key_claims":[' || CASE WHEN event_id % 6 = 0 THEN '' ELSE '{"id":"k1"}' END || ']},"source":{"input_text_level":"' || CASE WHEN event_id % 4 = 0 THEN 'abstract' ELSE 'full_text' END
 || '"},"trajectory_proposal":{"candidate_question":"' || CASE WHEN event_id % 3 = 0 THEN 'Why?' ELSE ' ' END || '"},"claim_map":[7,{"key_claim_id":"k1","evidence_type":["' || CASE WHEN event_id % 2 = 0 THEN 'Controlled experiment' ELSE 'assumed' END
 || '"],"overclaim_flags":[' || CASE WHEN event_id % 13 = 0 THEN '"missing-controls","scope overclaim"' ELSE '' END || ']}],"candidate_kernel_updates":[' || CASE WHEN event_id % 8 < 3 THEN '{"target_layer":"trajectory","candidate_id":"c1"}' ELSE '' END || ']}'"""
_TWIN = """WITH f AS (SELECT event_id AS k, event_id % 5 AS r, event_id % 4 = 0 AS abstract, event_id % 7 = 0 AS refresh, event_id % 11 = 0 AS high, event_id % 3 = 0 AS asks, event_id % 6 = 0 AS bare, event_id % 2 = 0 AS tested, event_id % 13 = 0 AS flagged, event_id % 8 < 3 AS tr,
 CASE event_id % 9 WHEN 0 THEN 'reject' WHEN 1 THEN 'escalate' WHEN 2 THEN 'defer' ELSE 'accept' END AS intake FROM events),
g AS (SELECT *, r = 2 AS conflict, r < 2 AS dir, r < 2 AND flagged AS design, abstract OR refresh AS thin, NOT bare AND tested AS gate FROM f),
h AS (SELECT *, dir AND NOT gate AS gb, asks AND (r = 3 OR high OR thin OR (dir AND NOT gate) OR design) AS opens, dir AND NOT thin AND gate AND NOT design AND NOT high AS revises, tr AND NOT conflict AS moves FROM g),
i AS (SELECT *, conflict OR thin OR ((gb OR design) AND NOT asks) AS acts FROM h)
SELECT k AS event_id, CASE WHEN conflict THEN 'conflict_resolution' WHEN thin THEN 'source_grounding' WHEN revises THEN 'belief_revision_pressure' WHEN opens THEN 'open_question_pressure' WHEN moves THEN 'trajectory_pressure' ELSE 'background_context' END AS primary_pressure,
 array_to_string(list_filter([CASE WHEN abstract THEN 'abstract_level_only' END, CASE WHEN refresh THEN 'refresh_required' END, CASE WHEN conflict THEN 'reader_or_relation_conflict' END, CASE WHEN high THEN 'high_uncertainty' END,
  CASE WHEN dir AND bare THEN 'no_frozen_key_claims' END, CASE WHEN gb AND NOT bare THEN 'key_claim_not_measured_or_tested' END, CASE WHEN design THEN 'claim_design_overclaim_boundary' END], lambda x: x IS NOT NULL), ',') AS blockers,
 CASE WHEN intake = 'reject' THEN 'intake_reject' WHEN intake = 'escalate' THEN 'intake_escalate' WHEN intake = 'defer' THEN 'intake_refresh' WHEN acts THEN 'frame_action_or_read' WHEN revises THEN 'frame_belief_revision' WHEN opens THEN 'frame_open_question' WHEN moves THEN 'frame_trajectory' ELSE 'none' END AS branch,
 CASE WHEN intake = 'reject' THEN 'no_change' WHEN intake <> 'accept' OR acts THEN 'request_action_or_read' WHEN revises THEN 'propose_belief_revision' WHEN opens THEN 'open_question' WHEN moves THEN 'propose_trajectory_update' ELSE 'no_change' END AS decision,
 CASE WHEN high OR intake = 'escalate' OR r = 2 THEN 'high' WHEN refresh OR r = 3 THEN 'medium' ELSE 'low' END AS uncertainty FROM i"""


@query("judgment_frames", _TWIN)
def judgment_frames(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.try_parse_json(F.expr(_ASSESSMENT)).alias("assessment"), F.try_parse_json(F.expr(_BRIEFING)).alias("briefing"))
    return J.decide(rows, "event_id").select("event_id", "frame.primary_pressure", F.array_join("frame.blockers", ",").alias("blockers"), "branch", "decision", F.col("uncertainty.level").alias("uncertainty"))
