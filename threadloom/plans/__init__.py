"""Named queries over the test tables, each with its SQL where SQL can say it."""

from threadloom.plans import checks, evaluation, general, more, texts

QUERIES = {**general.QUERIES, **texts.QUERIES, **evaluation.QUERIES, **more.QUERIES, **checks.QUERIES}
ORACLES = {**general.ORACLES, **texts.ORACLES, **evaluation.ORACLES, **more.ORACLES, **checks.ORACLES}
