"""Registered jobs run with the operators' own settings."""

from seqloom.jobs import registry
from seqloom.jobs.config import ModelConfig


def test_fit_maxent_takes_all_steps(monkeypatch):
    monkeypatch.setattr(registry, "_model", lambda spark, d, *parts: {"target": None, "violations": None})
    monkeypatch.setattr(registry.fitting, "fit", lambda target, violations, config=ModelConfig(): config)
    assert registry.QUERIES["fit_maxent"](None, "") == ModelConfig()
