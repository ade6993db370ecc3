"""pixelmill package."""
