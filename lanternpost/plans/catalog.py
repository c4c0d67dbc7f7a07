"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from . import answers, evaluation, knowledge, replies, search, storage, tagging

REGISTRIES = [m.registry for m in (tagging, knowledge, search, replies, answers, evaluation, storage)]

QUERIES = {name: fn for r in REGISTRIES for name, fn in r.queries.items()}
ORACLE = {name: text for r in REGISTRIES for name, text in r.oracle.items()}
