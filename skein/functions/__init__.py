"""Scalar kernels: column expressions and the few Arrow functions."""
