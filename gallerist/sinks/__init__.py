"""Writers of trees and caches outside the catalogue."""
