"""lodestone: a DataFrame-native engine for software-image facts."""
