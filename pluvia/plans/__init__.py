"""Registered queries."""

from pluvia.plans import registry, nowcasts, scores, places, kernels, archive, models, flows, issues, weather, learned  # noqa: F401, I001  (each adds to registry)
