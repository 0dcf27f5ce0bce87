"""Multi-step jobs: model training and scoring, seeded table generation."""
