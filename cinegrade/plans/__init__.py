"""End-to-end plans: rating models, model search, blending, guide comments, reasons."""
