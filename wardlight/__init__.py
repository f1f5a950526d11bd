"""Cohort analytics on Spark: lazy DataFrame operators over keyed encounter tables."""
