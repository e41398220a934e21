"""Registered queries and their SQL, by name."""

from __future__ import annotations

from weft.plans import answers, corpus, leakage, outline, preparation, records, search, training

QUERIES: dict = {**corpus.QUERIES, **training.QUERIES, **records.QUERIES, **preparation.QUERIES, **search.QUERIES, **leakage.QUERIES, **outline.QUERIES, **answers.QUERIES}
ORACLE: dict = {**corpus.ORACLE, **training.ORACLE, **records.ORACLE, **preparation.ORACLE, **search.ORACLE, **leakage.ORACLE, **outline.ORACLE, **answers.ORACLE}
