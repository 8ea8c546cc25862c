"""Nothing stateful lives here.

Row-local operators (array transforms, fitted recipes, presets, per-signal
quality, linear scoring) work unchanged on a streaming DataFrame;
``tests/test_sources.py`` runs them on one.
"""
