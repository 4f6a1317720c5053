"""Helpers that shape plans: materialisation in the shared folder and size-checked broadcasts."""
