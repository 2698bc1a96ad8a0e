"""Relatedness kernels, Bayesian models, predictions and simulators."""
