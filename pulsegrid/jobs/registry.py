"""Names of the registered queries and their SQL forms."""

from __future__ import annotations

from . import q_capacity, q_evaluation, q_hrv, q_recordings, q_signals, q_sources

ALL: dict = {**q_recordings.Q, **q_hrv.Q, **q_capacity.Q, **q_evaluation.Q, **q_signals.Q, **q_sources.Q}


def flagship(spark, sf_dir):
    return q_recordings.flagship(spark, sf_dir)


def queries():
    return {name: f for name, (f, _) in ALL.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in ALL.items() if sql}
