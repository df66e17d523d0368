"""Models that predict the next meeting, and their evaluation."""
