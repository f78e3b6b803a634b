"""Multi-step jobs: training, scoring, the end-to-end run."""
