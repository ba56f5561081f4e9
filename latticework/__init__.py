"""Dictionary- and feature-driven analysis of unsegmented text on Spark."""
