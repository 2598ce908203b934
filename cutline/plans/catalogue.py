"""Every registered query. Importing this module registers them all."""

from cutline.plans import q_features, q_form, q_models, q_quality, q_record, q_scoring, q_sources, q_streaming  # noqa: F401
