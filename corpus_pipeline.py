"""Corpus preparation, in stages that are run one after the other.  The stages are in tidewheel/llm/pipeline.py."""

from tidewheel.llm.pipeline import ORACLE_SQL, STAGES, leaks, near, passages, quality, run, tokens

__all__ = ["ORACLE_SQL", "STAGES", "leaks", "near", "passages", "quality", "run", "tokens"]
