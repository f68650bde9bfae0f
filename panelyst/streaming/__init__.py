"""No streaming operators: survey waves and chart extracts arrive as whole files.

The column-level parts (``functions``, ``operators.clean``, ``operators.recode``,
``operators.scales.score_scales``) are stateless projections, so they run unchanged
on a ``readStream`` table; ``tests/test_streaming.py`` shows it.
"""
