"""Operators for preparing large language-model training data; nothing outside this folder imports it."""
