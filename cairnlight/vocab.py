"""Vocabularies and rule tables as data. Operators take them as parameters; these are the defaults."""

from __future__ import annotations

# --- fixed values: weights and labels that results must equal ------------------------------------------------------
TIER_WEIGHTS = (5, 3, 1)
SCORE_FIELDS = ("relevance", "novelty", "bridge", "trajectory_influence", "concept_support")
MODE_WEIGHTS = {
    "general_judgment": (0.25, 0.20, 0.20, 0.20, 0.15),
    "mechanism_shift": (0.15, 0.30, 0.20, 0.25, 0.10),
    "transduction_route": (0.25, 0.20, 0.25, 0.20, 0.10),
    "platform_readiness": (0.20, 0.20, 0.20, 0.25, 0.15),
    "validation_readiness": (0.25, 0.10, 0.15, 0.20, 0.30),
    "translation_readiness": (0.30, 0.10, 0.20, 0.20, 0.20),
    "synthesis_map": (0.20, 0.10, 0.25, 0.30, 0.15),
    "agent_architecture": (0.25, 0.20, 0.20, 0.25, 0.10),
    "phenomenon_watch": (0.10, 0.30, 0.25, 0.25, 0.10),
    "screen": (0.20, 0.05, 0.15, 0.15, 0.45),
}
TYPE_MODES = {
    "mechanism_paper": "mechanism_shift",
    "transduction_or_device_paper": "transduction_route",
    "platform_or_method_paper": "platform_readiness",
    "validation_or_benchmark_paper": "validation_readiness",
    "clinical_or_translation_paper": "translation_readiness",
    "review_or_synthesis_paper": "synthesis_map",
    "computational_or_agent_paper": "agent_architecture",
    "fundamental_phenomenon_paper": "phenomenon_watch",
    "commentary_or_noise": "screen",
    "other_research": "general_judgment",
}
#: Short labels of a type; each type's own name is its label too.
TYPE_LABELS = {
    "mechanism_paper": ("mechanism", "mechanistic"),
    "transduction_or_device_paper": ("transduction", "device", "device_paper"),
    "platform_or_method_paper": ("platform", "method"),
    "validation_or_benchmark_paper": ("validation", "benchmark"),
    "clinical_or_translation_paper": ("clinical", "translation"),
    "review_or_synthesis_paper": ("review", "synthesis"),
    "computational_or_agent_paper": ("computational", "agent"),
    "fundamental_phenomenon_paper": ("fundamental",),
    "commentary_or_noise": ("commentary", "ignore"),
}
#: Ordered: the first type with a phrase in the text wins.
TYPE_PHRASES = (
    ("review_or_synthesis_paper", ("review", "perspective", "commentary", "editorial")),
    ("clinical_or_translation_paper", ("clinical", "patient", "human data")),
    ("validation_or_benchmark_paper", ("validation evidence", "benchmark", "new validation")),
    ("transduction_or_device_paper", ("new transduction principle", "device/electronics", "sensing", "transistor", "oect", "bioelectronic")),
    ("mechanism_paper", ("biological mechanism", "mechanistic evidence", "new mechanism", "pathway")),
    ("fundamental_phenomenon_paper", ("photophysics", "fundamental chemistry", "photochemistry", "polariton")),
    ("platform_or_method_paper", ("material platform", "manufacturing/fabrication", "new method", "new platform", "throughput")),
    ("computational_or_agent_paper", ("data/ai/computational", "agent", "llm", "algorithm", "computational")),
)
NON_RESEARCH = (
    "correction to", "author correction", "editorial", "news item", "errata", "erratum", "issue publication information", "issue editorial masthead",
    "in other journals", "beyond moonshots", "team updates at", "when 'don't eat me'", "a robot that", "old scientific art", "aaas unveils",
    "an uncommon introduction", "take it slow", "getting home in the dark", "silent interference", "researching while chinese",
    "in science journals", "has jwst spotted", "closing the loop", "stop",
)
JOURNAL_TIERS = (
    (1, ("nature", "science", "cell", "new england journal", "lancet")),
    (2, ("neuron", "immunity", "advanced materials", "advanced functional materials", "acs nano", "nano letters", "angewandte chemie", "jacs")),
)
RELATIONS = ("support", "challenge", "contest", "underdetermined", "neutral", "unclear")
RELATION_WORDS = {
    "support": ("support", "supports", "supported", "strengthen", "strengthens", "positive", "for"),
    "challenge": ("challenge", "challenges", "challenged", "weaken", "weakens", "negative", "against", "contradict", "contradicts"),
    "contest": ("contest", "contests", "contested", "mixed", "two-edged"),
    "underdetermined": ("ambiguous", "under-determined", "underdetermined", "insufficient", "pending", "needs-evidence"),
    "unclear": ("unclear", "unknown"),
    "neutral": ("neutral", "unrelated", "irrelevant", "off-topic"),
}
EVIDENCE_DELTAS = {"weak": 0.05, "moderate": 0.10, "strong": 0.20, "decisive": 0.35}
SOURCE_POINTS = {"experiment": 2.25, "benchmark": 2.25, "paper": 1.5, "report": 1.0, "user_observation": 0.75, "external": 0.5}
STRENGTH_LEVELS = ((3.25, "decisive"), (2.25, "strong"), (1.5, "moderate"))
SOURCE_ENTRENCHMENT = {"experiment": 0.035, "benchmark": 0.025, "paper": 0.006, "report": 0.006, "user_observation": 0.008, "external": 0.003}
CAPS = {"soft": (0.08, 0.92), "decisive": (0.03, 0.97), "override": (0.0, 1.0)}
OVERRIDE_ENTRENCHMENT, RESISTANCE, DEPENDENCY_STEP, DEPENDENCY_MOST = 0.08, 2.0, 0.08, 5
TASK_TYPES = {  # multiplier, adjustment
    "resolve_contested_object": (1.3, 6.0),
    "commit_or_reject_object": (1.25, 5.0),
    "sharpen_open_question": (1.2, 4.0),
    "verify_constraint": (1.1, 3.0),
    "judge_high_score_paper": (1.05, 2.0),
    "next_kernel_move": (0.9, 0.0),
    "sharpen_pressure_question": (0.75, 0.0),
    "verify_pressure_constraint": (0.2, -5.0),
}
DEFERRED_FRONTIER = "Abstract Kernel Constraints"
REVISION_ACTIONS = {"commit": ("approved", 1.5, 2.0), "approve": ("approved", 1.5, 2.0), "reject": ("rejected", -3.0, -2.0), "challenge": ("contested", -1.0, -0.5), "contradict": ("contested", -1.0, -0.5), "resolve": ("resolved", 0.5, 1.0), "reopen": ("candidate", 0.0, -1.0)}
MATCH_STOP_WORDS = tuple("a an the is are be to of in for on with that this if or and not no should can cannot must requires require required".split())
DRIFT_CLUSTERS = (
    ("catalytic/amplification", ("cataly", "enzym", "amplif", "cascade")),
    ("energy transduction", ("energy", "transduc", "convert", "harvest")),
    ("binding/recognition", ("bind", "affin", "recogn", "capture")),
    ("structural/assembly", ("structur", "assembl", "configur", "reconfig")),
    ("switching/gating", ("switch", "gating", "select", "modulat")),
    ("optical/photonic", ("light", "photon", "optic", "fluoresc")),
    ("electronic/electrochemical", ("electron", "charge", "current", "electrochem")),
)
STATES = ("evidence", "concept", "trajectory", "constraint", "uncertainty", "action")
OVERCLAIM_WEIGHTS = {
    "scope_overclaim": 0.25, "causal_overclaim": 0.3, "mechanism_overclaim": 0.3, "translational_overclaim": 0.35, "platform_overclaim": 0.25,
    "sensitivity_overclaim": 0.2, "robustness_overclaim": 0.2, "benchmark_overclaim": 0.2, "unsupported_generalization": 0.25, "missing_controls": 0.2, "claim_design_mismatch": 0.25,
}
# --- end of fixed values ----------------------------------------------------------------------------------------


def dictionary(*tiers: tuple[str, ...], weights: tuple[int, ...] = TIER_WEIGHTS) -> dict[str, int]:
    """Phrase to weight from tiers in order; a phrase of several tiers has the last one's weight."""
    return {p: w for tier, w in zip(tiers, weights, strict=True) for p in tier}


#: For the standard tables, whose prose is invented: rare, middling and common pieces of its English words.
TABLE_TIERS = (("enwh", "inging", "nttion", "hati", "lyon"), ("ther", "tion", "thes"), ("that", "with", "this", "from"))
TABLE_DICTIONARY = dictionary(*TABLE_TIERS)

# --- fixed values: term lists of the relation readers and their types ---------------------------------------------
READER_TERMS = {
    "readout": ("assay", "biosensor", "bioelectronic", "capacitance", "diagnostic", "detection", "electrochemical", "electronic signal", "impedance", "oect", "organic electrochemical", "readout", "sensor", "sensing", "transduc", "transistor"),
    "biology": ("activity-affinity", "activity based", "activity-based", "biological state", "bacteria", "cell state", "disease", "ev", "evs", "extracellular vesicle", "functional readout", "living", "metastatic", "metabolism", "molecular recognition", "organoid", "plasma", "serum", "untreated plasma", "whole-cell"),
    "preservation": ("complex biological", "direct living", "directly from", "functional", "label-free", "matrix interference", "preserve", "real-time", "traceably", "untreated", "without complex purification"),
    "mechanism": ("charge transfer", "coupling", "dispersion", "field", "mechanism", "mechanotransduction", "photochem", "photophysics", "phonon", "polariton", "reusable", "state", "topological", "transduction mechanism"),
    "platform": ("assay", "method", "platform", "workflow", "single-cell", "screening", "microfluidic", "integration"),
    "anchor": ("activity-affinity", "bioelectronic", "bodipy", "direct living transducer", "ev", "evs", "extracellular vesicle", "functional ev", "nanophotonic", "oect", "organoid", "organic electrochemical", "photocleavage", "photochem", "polariton", "untreated plasma"),
    "connection": ("aligns with", "could be coupled", "could be integrated", "could inform", "directly relevant", "directly connects", "directly implementable", "extends", "future oect", "integrated into", "relevant to your", "supports"),
    "conflict": ("contradicts the belief", "challenges the belief", "undermines the belief", "undermines the premise", "evidence against", "fails to preserve biological meaning", "fails to preserve biological context", "cannot distinguish signal from noise", "does not distinguish signal from noise"),
    "off_topic": ("far outside", "fundamentally different", "not aligned", "orthogonal", "weak connection", "weak relevance", "no direct connection", "no direct relevance", "not directly relevant"),
    "active": ("bioelectronic", "ev", "evs", "extracellular vesicle", "molecular", "nanophotonic", "oect", "organoid", "photochem", "sensor", "sensing", "transduction"),
    "state": ("disease state", "cell state", "model", "mechanism", "immune", "tissue"),
    "synthesis": ("review", "perspective", "prior", "constraint", "gap"),
    "overview": ("review", "perspective"),
    "unspecified": ("does not specify the biological state", "does not specify biological state", "without a specific biological readout"),
    "carrier": ("oect", "ev"),
}
INTAKE_TYPES = (
    ("synthesis_or_review", "synthesis_prior", ("review", "perspective")),
    ("sensing_or_diagnostic", "transduction_validity", ("sensor", "sensing", "biosensor", "detection", "diagnostic", "assay", "readout", "phenotyping")),
    ("mechanism_paper", "mechanism_to_coupling", ("photophysics", "photochem", "polariton", "mechanism", "fundamental")),
    ("platform_or_method", "platform_bridge", ("platform", "method", "workflow", "engineering")),
    ("biology_mechanism", "biological_relevance", ("biological", "immune", "tissue", "disease", "cell")),
)
# --- end of fixed values ----------------------------------------------------------------------------------------
