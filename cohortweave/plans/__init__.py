"""Plans that bind the operators to tables, and the whole cohort run."""
