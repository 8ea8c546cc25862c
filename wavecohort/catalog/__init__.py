"""The registered queries with their SQL counterparts."""

from wavecohort.catalog import fits, grouped, scores, tables, transforms, views  # noqa: F401
