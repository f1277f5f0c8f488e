"""Finding and redacting personal data with Spark. The names below are imported when they are first used."""

from importlib import import_module

_EXPORTS = {
    "Settings": "umbra.settings",
    "anonymize": "umbra.plans.pipeline",
    "detect": "umbra.plans.pipeline",
    "normalise": "umbra.plans.pipeline",
    "reidentify": "umbra.operators.channels",
    "model_detectors": "umbra.operators.detectors",
    "RECOGNIZERS": "umbra.operators.recognizers",
    "Recognizer": "umbra.operators.recognizers",
}
__all__ = sorted(_EXPORTS)


def __getattr__(name: str):
    if name in _EXPORTS:
        return getattr(import_module(_EXPORTS[name]), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
