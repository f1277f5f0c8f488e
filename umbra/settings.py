"""Settings of the detection and redaction plans. Values become literals of the plan."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    # Model names are handed to plug-in detectors; the plans don't load models themselves.
    device: str = "auto"
    pii_model: str = ""
    org_model: str = ""
    mlm_model: str = ""
    zero_shot_model: str = ""
    pii_threshold: float = 0.7
    org_threshold: float = 0.7
    gliner_threshold: float = 0.4
    presidio_threshold: float = 0.4
    anomaly_threshold: float = 0.5
    perplexity_threshold: float = 0.3
    kapa_review_threshold: float = 0.85
    quasi_id_window: int = 200
    fix_encoding: bool = True
    use_adversarial_normalization: bool = True
    use_leetspeak_normalization: bool = True
    use_regex_fallback: bool = True
    use_presidio_compat: bool = True
    use_gliner: bool = True
    use_anomaly_detection: bool = True
    use_whitelist: bool = True
    run_quality_check: bool = True
    always_review_art9: bool = True
    #: Match recognizers' letters as written. Off, as case is ignored by default even where a pattern asks for capitals.
    strict_case: bool = False
    max_text_chars: int = 50_000
    max_request_bytes: int = 500_000
    audit_export_days: int = 7
    pii_redact_after_days: int = 90
    hard_delete_after_days: int = 2555
    evaluator_iou: float = 0.5

    def replace(self, **changes) -> Settings:
        return replace(self, **changes)

    @classmethod
    def from_env(cls, prefix: str = "UMBRA_", env: dict | None = None) -> Settings:
        """Settings with the fields that PREFIX_NAME variables name. Booleans: 1, true, yes or on."""
        env = os.environ if env is None else env
        found = {}
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper())
            if raw is not None:
                kind = type(f.default)
                found[f.name] = raw.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)
        return cls(**found)

    @classmethod
    def profile(cls, name: str = "library", **changes) -> Settings:
        """The stages of an entry point: library, legacy (no recognizers, whitelist or zero-shot), rest (no whitelist or zero-shot)."""
        known = {
            "library": {},
            "legacy": {"use_presidio_compat": False, "use_gliner": False, "use_whitelist": False, "use_leetspeak_normalization": True},
            "rest": {"use_gliner": False, "use_whitelist": False, "use_leetspeak_normalization": True},
        }
        if name not in known:
            raise ValueError(f"unknown profile {name!r}; known: {', '.join(known)}")
        return cls(**(known[name] | changes))
