"""Column functions: text, time, geography, prices, classification and moderation."""
