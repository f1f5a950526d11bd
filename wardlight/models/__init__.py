"""Preparation, fitting, evaluation, selection and explanation of classifiers."""
