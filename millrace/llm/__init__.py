"""Training-data operators: filters, near-duplicate removal, mixing, packing and stored forms.

Nothing outside this folder imports it.
"""
