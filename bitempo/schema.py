"""Column vocabulary of the tables, and the four states of an answer.

versions: entity, attribute, seq, state, value, valid_from, valid_to, tx, source, session
edges:    subject, predicate, object, seq, present, valid_from, valid_to, tx

``seq`` is the append position and decides ties; instants are epoch milliseconds; a
null valid_to is open. A tombstone is a row with state 'absent' and a null value.
"""

from __future__ import annotations

VALUE, ABSENT, UNKNOWN, REFUSED = "value", "absent", "unknown", "refused"
TRIPLE = ["subject", "predicate", "object"]
LOG = ["entity", "attribute"]
DAY_MS = 86_400_000
