"""Cache-membership folds over unreliable event streams, and operators on large tables, on Spark."""
