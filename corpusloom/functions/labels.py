"""Controlled labels and their display, and vocabularies read from their files."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import at_path, csv_any

# Display of controlled labels.
DISPLAY = {
    "ChatGPT_unspecified": "ChatGPT (version unspecified)",
    "OpenAI_o_series": "OpenAI o-series",
    "T5_FLAN": "T5 / FLAN",
    "vr_ar_xr": "Virtual, augmented or extended reality",
    "osce": "Objective structured clinical examination",
    "roleplay": "Role-play",
    "decision_making": "Decision-making",
    "situational_awareness": "Situational awareness",
    "task_management": "Task management",
    "stress_management": "Stress management",
    "no_explicit_nts": "No explicit NTS domain",
    "no_explicit_simulation_method": "No explicit simulation method identified",
    "randomized_trial": "Randomized trial",
    "nonrandomized_comparative": "Non-randomized comparative",
    "pre_post": "Pre-post",
    "mixed_methods": "Mixed methods",
    "development_evaluation": "Development/evaluation",
    "evidence_review": "Evidence review",
    "methods_framework": "Methods/framework",
    "other_named": "Other named model",
    "unspecified_generative_model": "Unspecified generative model",
    "virtual_patient": "Virtual patient",
    "standardized_patient": "Standardized patient",
    "task_trainer": "Task trainer",
    "serious_game": "Serious game",
    "openalex": "OpenAlex",
    "pubmed": "PubMed",
    "europepmc": "Europe PMC",
    "semantic_scholar": "Semantic Scholar",
    "doaj": "DOAJ",
}

# Countries with a display name.
COUNTRIES = {
    "US": "United States",
    "CN": "China",
    "GB": "United Kingdom",
    "AU": "Australia",
    "KR": "South Korea",
    "DE": "Germany",
    "JP": "Japan",
    "IN": "India",
    "CA": "Canada",
    "ES": "Spain",
}

# Exclusion codes.
EXCLUSIONS = {
    "E1_NOT_LLM": "No explicit large or generative language model",
    "E2_NOT_HEALTH_ED": "Not health-professions education, training or assessment",
    "E3_NOT_SIMULATION": "Simulation-based education absent or peripheral",
    "E4_CLINICAL_ONLY": "Clinical use without a simulation-training purpose",
    "E5_INELIGIBLE_TYPE": "Ineligible or inadequately reported publication type",
    "E6_OUT_OF_RANGE": "Outside the date range",
    "E7_NOT_ASSESSABLE_IN_ENGLISH": "Not assessable from available English information",
    "E9_OTHER": "Other stated reason",
}

# Specialties by group; other keys that hold "surgical", or a word "surgery", are surgical too.
SURGICAL = (
    "surgery", "general surgery", "orthopaedic surgery", "neurosurgery", "otolaryngology", "plastic surgery", "cardiothoracic surgery", "vascular surgery", "paediatric surgery",
    "pediatric surgery", "transplant surgery", "bariatric surgery", "spine surgery", "urology", "operative obstetrics and gynaecology", "operative obstetrics and gynecology",
)
GENERAL = (
    "medicine", "general medical education", "health professions", "health professions education", "healthcare professionals", "healthcare education", "interprofessional",
    "simulation education", "undergraduate medical education", "medical education faculty development",
)
SPECIALTY_GROUPS = {"surgical specialty": (SURGICAL, (" surgery", "surgical")), "general or multi-professional": (GENERAL, ())}
OTHER_SPECIALTIES = "other clinical specialty or profession"

# The four domains of the candidate filter.
DOMAINS = {
    "language_model": r"\b(?:large\s+language\s+models?|small\s+language\s+models?|language\s+models?|generative\s+(?:artificial\s+intelligence|ai)|genai|generative\s+pre[- ]?trained\s+transformers?|foundation\s+models?|chat\s*gpt|gpt(?:[- .]?(?:[1-9](?:\.5)?|4o|o1|o3))?|claude|gemini|bard|llama\s*\d*|mistral|mixtral|copilot|med[- ]?palm|palm\s*2?|biogpt|medgpt|meditron|deepseek(?:[- ]r1)?|qwen\s*\d*|phi[- ]?\d|falcon|vicuna|alpaca|grok|command\s*r|retrieval[- ]augmented\s+generation|rag|conversational\s+ai|conversational\s+agents?|ai[- ](?:powered|based|driven|assisted)\s+(?:chatbots?|agents?|virtual\s+patients?|simulat\w*)|natural\s+language\s+processing|nlp|transformer\s+models?|ai\s+chatbots?|intelligent\s+tutoring\s+systems?)\b",
    "healthcare": r"\b(?:health(?:care|\s+care|\s+professions?|\s+professional)?|medical|medicine|clinical|patient|nurs\w*|physician|doctor|surg\w*|dental|dent\w*|pharmac\w*|an(?:a?e)sthes\w*|urolog\w*|cardiol\w*|oncol\w*|p[ae]diatr\w*|emergency|resuscitation|hospital|allied\s+health|midwi\w*|paramedic|radiograph\w*|physiotherap\w*|occupational\s+therap\w*)\b",
    "education_training": r"\b(?:educat\w*|teach\w*|train\w*|learn\w*|student\w*|resident\w*|curricul\w*|pedagog\w*|faculty|instructor\w*|competenc\w*|skills?|assessment|examin\w*|clerkship\w*|boot\s?camp\w*|continuing\s+professional\s+development|undergraduate\w*|postgraduate\w*|fellow\w*)\b",
    "simulation": r"\b(?:simulat\w*|virtual\s+patients?|standardi[sz]ed\s+patients?|osces?|objective\s+structured\s+clinical\s+examin\w*|role[- ]?plays?|debrief\w*|mannequins?|manikins?|high[- ]fidelity|low[- ]fidelity|mixed\s+reality|augmented\s+reality|virtual\s+reality|immersive|haptic|serious\s+games?|scenario[- ]based\s+(?:train\w*|learn\w*|educat\w*)|clinical\s+scenarios?|patient\s+scenarios?|skills?\s+labs?|simulation\s+cent(?:re|er)s?|task\s+trainers?|mock\s+codes?|sim\s+labs?)\b",
}
BOUNDARY_POOLS = {"simulation": "BOUNDARY_NO_SIM", "education_training": "BOUNDARY_NO_ED", "healthcare": "BOUNDARY_NO_HEALTH"}


def phrase_dictionary(document: dict[str, Any], path: str) -> tuple[dict[str, list[str]], list[str]]:
    """Labels with their variants from a specification's list at a dotted path, and the labels of its scope check."""
    entries = at_path(document, path) or []
    return {e["label"]: list(e["variants"]) for e in entries}, [e["label"] for e in entries if e.get("group") == "scope_check"]


def thesaurus(spark: SparkSession, path: str) -> tuple[dict[str, list[str]], DataFrame]:
    """Concepts with their variants from a CSV of concept_id, domain, concept_label and variants (``|`` between), and its other columns."""
    df = csv_any(spark, path, ["concept_id", "variants"])
    rows = df.select("concept_id", "variants").collect()  # a vocabulary, not data
    return {r["concept_id"]: [v for v in (r["variants"] or "").split("|") if v] for r in rows}, df.drop("variants")
