"""Query modules; importing one registers its queries."""

from eventide.plans import documents, gates, market, more, relational, rules, selection, strata, study, verdicts, views  # noqa: F401
