"""Column expressions. Nothing here touches a DataFrame."""
