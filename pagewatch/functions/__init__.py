"""Pure ``Column -> Column`` expressions used by every operator."""
