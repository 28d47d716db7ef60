"""Evidence-grounded decision pipelines as DataFrame operators."""
